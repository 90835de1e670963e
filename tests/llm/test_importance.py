"""Importance resampling against a plain version; the selection against sorting."""
import hashlib
import math
import random
import re
import zlib

import pytest
from test_llm import edges, frame, prose

from ledgerspark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, runs):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(ws[i:i + n]) for n in range(1, runs + 1) for i in range(len(ws) - n + 1)], len(ws)


def plain(docs, target, share=(10, 100), least=20, buckets=10_000, runs=1, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for count, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text, runs)[0]:
                count[bucket(f)] += 1
    S, T = sum(s), sum(t)
    out, keys = [], []
    for row, (i, text) in enumerate(docs):
        fs, words = features(text, runs)
        g = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, fs)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, score, None])
        if words >= least:
            keys.append((-score, i is None, i or 0, row))
    for rank, key in enumerate(sorted(keys)[:len(keys) * share[0] // share[1]], 1):
        out[key[3]][4] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("handful,parameters", [(4096, {}), (3, {}), (1, dict(share=(55, 100), least_words=3, buckets=50, runs=3, seed=7))])
def test_resample_equals_plain(spark, monkeypatch, handful, parameters):
    monkeypatch.setattr(importance, "HANDFUL", handful)
    monkeypatch.setattr(importance.cutoff, "__defaults__", (handful,))
    rng = random.Random(handful)
    target = [prose(40, rng) for _ in range(5)] + [None, "", "Ünïcode WÖRDS 123"]
    texts = edges() + [prose(rng.choice([1, 19, 20, 21, 60]), rng) for _ in range(200)] + [target[0] + " " + prose(10, rng) for _ in range(20)]
    df, docs = frame(spark, texts)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    out = importance.resample(df.repartition(5), bench, **parameters)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in out.dtypes} == {"bigint"}
    kw = {{"least_words": "least"}.get(k, k): v for k, v in parameters.items()}
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = plain(docs, target, **kw)
    # equal rows share their ranks in any order
    assert got == want
    won = {r[0] for r in want if r[4] is not None}
    kept = importance.draw(df, bench, **parameters)
    assert {r.doc_id for r in kept.collect()} == won and kept.columns == df.columns


def test_resample_of_little(spark):
    df, _ = frame(spark, edges())
    bench = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(df.limit(0), bench).count() == 0
    out = importance.resample(df, bench).collect()
    assert len(out) == df.count() and all(r.rank is None for r in out)      # fewer than ten eligible
    assert importance.resample(df, bench, share=(1, 1), least_words=0).filter("rank is null").count() == 0


@pytest.mark.parametrize("kind", ["ties", "few", "sorted", "hot"])
def test_cutoff_equals_sorting(spark, kind):
    rng = random.Random(1)
    n = 3000
    score = {"ties": lambda i: rng.randint(0, 3), "few": lambda i: 5, "sorted": lambda i: i,
             "hot": lambda i: 7 if i % 3 else rng.randint(-50, 50)}[kind]
    rows = [(score(i), None if i % 97 == 0 else (5 if i % 3 == 0 else i // 2), i) for i in range(n)]
    df = spark.createDataFrame(rows, "score long, doc_id long, row long").repartition(9, "row")
    order = sorted(rows, key=importance._sort_key)
    for rank in (1, 2, 299, n // 2, n):
        assert importance.cutoff(df, rank, handful=4) == order[rank - 1]
    assert importance.cutoff(df, 0) is None and importance.cutoff(df, n + 1) is None
    ranks = {tuple(r)[:3]: r["rank"] for r in importance.ranked(df).collect()}
    assert [ranks[k] for k in order] == list(range(1, n + 1))


def test_weighted_median_leaves_a_quarter_on_both_sides():
    rng = random.Random(2)
    for _ in range(200):
        parts = [sorted(rng.random() for _ in range(rng.randint(1, rng.choice([1, 5, 100])))) for _ in range(rng.randint(1, 12))]
        found = [(0, len(p), (-p[(len(p) - 1) // 2], 0, 0)) for p in parts]
        pivot = -importance._weighted_median(found)[0]
        every = [x for p in parts for x in p]
        assert sum(x <= pivot for x in every) >= len(every) / 4 and sum(x >= pivot for x in every) >= len(every) / 4
