"""Exact selection and rank sums against plain sorting, with hot groups and ties."""
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import selection as X
from ledgerspark.operators import subscriptions as S


def amounts(rng, n):
    kinds = [lambda: rng.randint(-50, 50), lambda: rng.randint(-10**9, 10**9), lambda: 1234, lambda: rng.choice([-1, 0, 1, 10**15])]
    return [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 5)}", kinds[rng.randrange(4)]()) for _ in range(n)]


def test_at_ranks_equals_sorting(spark):
    rows = amounts(random.Random(1), 4000)
    df = spark.createDataFrame([(g, Decimal(c) / 100) for g, c in rows] + [("hot", None)], "g string, v decimal(18,2)")
    counts = X.value_counts(df, ["g"], "v", X.money_range)
    ranks = {"first": F.lit(0), "q1": F.floor((F.col("tot") - 1) * 0.25), "mid": F.floor((F.col("tot") - 1) / 2), "last": F.col("tot") - 1}
    got = {r.g: r for r in X.at_ranks(counts, ["g"], "v", ranks).collect()}
    for g in {g for g, _ in rows}:
        v = sorted(Decimal(c) / 100 for h, c in rows if h == g)
        n = len(v) - 1
        assert (got[g].first, got[g].q1, got[g].mid, got[g].last) == (v[0], v[n // 4], v[n // 2], v[-1])


def test_money_ranges_keep_the_order_and_are_few(spark):
    cents = sorted({s * c for s in (-1, 1) for k in range(0, 60) for c in (2**k - 1, 2**k, 2**k + 1) if c < 10**17} | set(range(-3000, 3000)))
    rows = spark.createDataFrame([(Decimal(c) / 100,) for c in cents], "v decimal(18,2)")
    keys = [r.k for r in rows.select("v", X.money_range(F.col("v")).alias("k")).orderBy("v").collect()]
    assert keys == sorted(keys)
    every = spark.range(0, 10**6).select(X.money_range((F.col("id") / 100).cast("decimal(18,2)")).alias("k"))
    assert every.distinct().count() < 14_000


def test_ranges_of_a_hot_group_go_to_many_tasks(spark):
    df = spark.range(0, 50_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 100_003 / 100).cast("decimal(18,2)").alias("v"))
    counts = X.value_counts(df, ["g"], "v", X.money_range)
    sizes = [r["count"] for r in counts.repartition(8, "g", "range").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]


@pytest.mark.parametrize("ties", [2, 1000])
def test_auc_counts_ties_half(spark, ties):
    rng = np.random.default_rng(ties)
    y = rng.integers(0, 2, 700)
    s = np.round((rng.random(700) + 0.3 * y) / 1.3 * ties) / ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)] + [(None, 0.5), (1, None)], "label int, score double").repartition(7)
    r = S.evaluation(df, 0.5).first()
    p, n = s[y == 1], s[y == 0]
    auc = ((p[:, None] > n).sum() + (p[:, None] == n).sum() / 2) / len(p) / len(n)
    tp, fp = (p >= 0.5).sum(), (n >= 0.5).sum()
    assert r.auc == pytest.approx(auc, abs=1e-14)
    assert (r.precision, r.recall) == pytest.approx((tp / (tp + fp), tp / len(p)))
    assert r.f1 == pytest.approx(2 * tp / (tp + fp + len(p)))
    one = S.evaluation(df.filter("label = 1"), 0.5).first()
    assert one.auc is None and S.evaluation(df.limit(0)).first().f1 == 0.0
