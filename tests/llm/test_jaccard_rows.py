"""Copies emit no signatures, and documents without a possible link drop out early."""
import random

import brute
from test_llm import table

from ledgerspark.llm import jaccard

FIELDS = "doc_id long, text string"


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randint(0, 10 ** 6)}" for _ in range(n)]


def counted(monkeypatch, name):
    """Row counts of what is staged under the name."""
    seen, real = [], jaccard.staged

    def staged(df, as_name):
        out = real(df, as_name)
        if as_name == name:
            seen.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "staged", staged)
    return seen


def test_copies_emit_once(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(words(rng, 60)) for _ in range(5)]
    rows = [(i, texts[i % 5] if i % 2 else texts[i % 5].upper()) for i in range(100)]
    near = texts[1].split()
    near[30] = "other"
    # an id with two rows: one is a copy, the other links two documents by its own words
    rows += [(200, texts[0]), (200, " ".join(near)), (None, texts[2]), (300, ""), (301, None)]
    df = spark.createDataFrame(rows, FIELDS).repartition(7)
    emitted, real = [], jaccard._emit
    monkeypatch.setattr(jaccard, "_emit", lambda docs, level: emitted.append(docs.filter("doc_id is not null").count()) or real(docs, level))
    buckets = counted(monkeypatch, "buckets")
    got = table(jaccard.near_duplicates(df).filter("doc_id <> 200 and doc_id is not null").distinct(), "n_shingles", "component_id")
    assert emitted[0] == 5 + 2 + 2 and buckets[0] < 400
    want = brute.components([d for d in rows if d[0] is not None and d[0] != 200])
    # 200 joins the documents of texts 0 and 1
    joined = {want[i][1] for i in (0, 1)}
    assert got == {i: (n, min(joined) if c in joined else c) for i, (n, c) in want.items()}


def test_a_shared_passage_alone_is_dropped(spark, monkeypatch):
    rng = random.Random(5)
    passage = words(rng, 12)
    rows = [(i, " ".join(words(rng, 150) + passage + words(rng, 150))) for i in range(40)]
    df = spark.createDataFrame(rows, FIELDS).repartition(3)
    apart = counted(monkeypatch, "apart")
    got = table(jaccard.near_duplicates(df), "n_shingles", "component_id")
    assert got == brute.components(rows) and apart == [0]


def test_signatures_equal_in_32_bits_still_count(spark, monkeypatch):
    """All hot signatures fall on one of 32 bits; no link may be lost by it."""
    from pyspark.sql import functions as F
    rng = random.Random(6)
    base = words(rng, 120)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(120)] = f"z{rng.randint(0, 10 ** 6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    monkeypatch.setattr(jaccard, "HOT_PAIRS", 3)
    monkeypatch.setattr(F, "hash", lambda *cols: F.lit(1))
    assert table(jaccard.near_duplicates(df), "n_shingles", "component_id") == brute.components(rows)
