"""k-NN: bounds lose no neighbour, documents of similarity 0 fill up, long lists are cut."""
import random

import pytest
from pyspark.sql import functions as F
from test_categorize import brute

from ledgerspark.operators import categorize as C

LABELS = ["Bars", "Coffee", "Gas", "Rent"]


def scored(spark, train, queries, k, threshold):
    index = C.fit_tfidf(C.training_table(spark.createDataFrame(train, "description string, category string")))
    q = spark.createDataFrame([(x,) for x in queries], "description string")
    return {r.description: (r.category, r.confidence) for r in C.score_texts(q, *index, k, threshold).collect()}


@pytest.mark.parametrize("part,k,threshold", [(20_000, 5, 0.35), (7, 12, 0.1), (7, 1, 0.0)])
def test_common_and_rare_terms(spark, monkeypatch, part, k, threshold):
    """One term in all texts, some in a third, most rare; also with cut lists."""
    monkeypatch.setattr(C, "LIST_PART", part)
    rng = random.Random(part)
    rare = ["word" + chr(97 + i) + chr(97 + j) for i in range(8) for j in range(8)]
    train = [(" ".join(["CARD"] + rng.sample(["BIG", "SMALL"], rng.randint(0, 1)) + rng.sample(rare, rng.randint(0, 3))).upper(),
              rng.choice(LABELS)) for _ in range(150)]
    train += [train[0]] * 9 + [("", "Gas")]
    queries = {" ".join(rng.sample(["CARD", "BIG", "SMALL"], rng.randint(0, 2)) + rng.sample(rare, rng.randint(0, 3))).upper()
               for _ in range(60)} | {"CARD", "NOTHING KNOWN", train[0][0]}
    want = brute(train, queries, k, threshold, set(C.english_stop_words()))
    got = scored(spark, train, queries, k, threshold)
    for q in queries:
        assert got[q][1] == pytest.approx(want[q][1], abs=2e-6), q
        assert got[q][0] == want[q][0], q


def test_documents_of_similarity_zero_vote(spark):
    train = [("COFFEE HOUSE", "Coffee"), ("GAS", "Gas"), ("PUMP", "Gas"), ("FUEL", "Gas")]
    # one neighbour of similarity 1, two of similarity 0 and one label: they win
    assert scored(spark, train, ["COFFEE HOUSE"], 3, 0.0)["COFFEE HOUSE"] == ("Gas", 0.0)
    assert scored(spark, train, ["COFFEE HOUSE"], 3, 0.2)["COFFEE HOUSE"] == ("Uncategorized", 0.0)
    assert scored(spark, train, ["COFFEE HOUSE"], 1, 0.2)["COFFEE HOUSE"] == ("Coffee", 1.0)


def test_long_list_is_dealt_evenly(spark, monkeypatch):
    """A term that all texts share: no partition holds over twice the median of its postings."""
    monkeypatch.setattr(C, "LIST_PART", 500)
    train = [(f"CARD w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} x", LABELS[i % 4]) for i in range(20_000)]
    _, postings = C.fit_tfidf(C.training_table(spark.createDataFrame(train, "description string, category string")))
    stats = postings.groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    parted, long_lists = C._parts(postings, stats)
    assert [r.term for r in long_lists.collect()] == ["card"]
    sizes = [r["count"] for r in parted.repartition(4, "term", "part").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * sorted(sizes)[1]
    one = [r["count"] for r in parted.filter("term = 'card'").groupBy("part").count().collect()]
    assert len(one) > 30 and max(one) <= 2 * sorted(one)[20]


def test_common_terms_are_not_read_where_rare_ones_suffice(spark):
    train = [("CARD " + w, "Gas") for w in ("alpha", "beta", "gamma", "delta")] * 5 + [(f"CARD shop{chr(97 + i)}", "Bars") for i in range(20)]
    vocab, postings = C.fit_tfidf(C.training_table(spark.createDataFrame(train, "description string, category string")))
    stats = postings.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("neighbours"), F.max("w").alias("most"))
    q = C.query_vectors(spark.createDataFrame([("CARD ALPHA",)], "norm string"), vocab)
    reach = {r.term: (r.first, r.rest) for r in C._reach(q.join(stats, "term"), 5).collect()}
    assert reach["alpha"][0] and not reach["card"][0]
    assert reach["card"][1] < 0.6 < reach["alpha"][1]
