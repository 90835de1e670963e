"""What hangs together already is not gone through again when further links come."""
import random

import brute
from test_llm import table

from ledgerspark.llm import components, jaccard

FIELDS = "doc_id long, text string"


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randint(0, 10 ** 6)}" for _ in range(n)]


def test_copies_are_joined_once(spark, monkeypatch):
    rng = random.Random(8)
    base, copied = words(rng, 120), words(rng, 40)
    rows = [(i, " ".join(copied)) for i in range(700)]
    other = list(copied)
    other[20] = "other"
    rows += [(-1, " ".join(other))]                # a smaller id takes the whole group over
    for i in range(1000, 1060):                    # nearly linked: work for every level
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(120)] = f"z{rng.randint(0, 10 ** 6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, FIELDS).repartition(4)
    monkeypatch.setattr(jaccard, "HOT_PAIRS", 3)
    seen, real = [], components.staged

    def staged(df, name):
        out = real(df, name)
        seen.append(out.count())
        return out
    monkeypatch.setattr(components, "staged", staged)
    got = table(jaccard.near_duplicates(df), "n_shingles", "component_id")
    assert got == brute.components(rows)
    assert sum(n >= 699 for n in seen) == 1


def test_no_pairs_end_early(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], FIELDS)
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(jaccard, "per_document", None)          # no set is made
    assert jaccard.verify(docs, none, doubtful=True).columns == ["a", "b"]


def test_merged_components(spark):
    comps = spark.createDataFrame([(1, 1), (5, 1), (9, 1), (2, 2), (7, 2), (30, 30), (31, 30)], "node long, comp long")
    links = spark.createDataFrame([(9, 7), (5, 9), (7, 0), (40, 41)], "a long, b long")
    got = {r.node: r.comp for r in jaccard._merged(comps, links).collect()}
    assert got == {0: 0, 1: 0, 5: 0, 9: 0, 2: 0, 7: 0, 30: 30, 31: 30, 40: 40, 41: 40}
