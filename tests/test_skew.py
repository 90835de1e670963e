"""A hot account (most rows) and a hot merchant inside it: the operators give
the same results whether Spark broadcasts the small sides or falls back to
sort-merge joins with AQE splitting the skewed partitions."""

import datetime as dt
import random

import pytest

from ledgerspark.operators import periods as E
from ledgerspark.operators import savings as G
from ledgerspark.operators import subscriptions as S
from ledgerspark.operators import summary as D

FORCE_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}


def skewed_rows(n=6000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        acct = "hot" if rnd.random() < 0.6 else f"a{rnd.randint(0, 40)}"
        merch = "BIGSHOP" if acct == "hot" and rnd.random() < 0.7 else f"SHOP{rnd.randint(0, 30)}"
        day = dt.date(2023, 1, 1) + dt.timedelta(days=rnd.randint(0, 500))
        amt = round(rnd.uniform(-200, -1), 2) if rnd.random() < 0.9 else round(rnd.uniform(100, 3000), 2)
        cat = "Income" if amt > 0 else rnd.choice(["Coffee", "Rent", "Travel", "Groceries", "Misc"])
        rows.append((acct, day.isoformat(), merch, amt, cat))
    return rows


def run_all(t):
    out = {
        "cat": E.categories_by_period(t, "90d"),
        "series": E.daily_series(t, "30d"),
        "cvp": E.current_vs_prior(t),
        "merch": E.top_merchants(t, 5),
        "totals": D.account_totals(t),
        "profile": D.file_profile(t, 5),
        "features": S.merchant_features(S.expense_projection(t)),
        "levers": G.top_levers(t),
    }
    return {k: sorted(map(tuple, v.collect())) for k, v in out.items()}


def test_skew_paths_agree(spark, ledger):
    t = ledger(skewed_rows())
    base = run_all(t)
    old = {k: spark.conf.get(k, None) for k in FORCE_SKEW}
    try:
        for k, v in FORCE_SKEW.items():
            spark.conf.set(k, v)
        forced = run_all(t.repartition(13))
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    for k in base:
        assert base[k] == forced[k], k
    hot = [r for r in base["features"] if r[0] == "hot" and r[1] == "BIGSHOP"][0]
    assert hot[2] > 2000                                   # the hot group really is hot


@pytest.mark.parametrize("parts", [1, 5])
def test_features_partition_invariant(spark, ledger, parts):
    t = ledger(skewed_rows(2000, seed=9))
    a = sorted(map(tuple, S.merchant_features(S.expense_projection(t)).collect()))
    b = sorted(map(tuple, S.merchant_features(S.expense_projection(t.repartition(parts))).collect()))
    assert a == b


@pytest.mark.parametrize("report", [
    lambda t: E.categories_by_period(t, "90d"), lambda t: E.series_summary(t, "30d"),
    lambda t: E.category_summary(t, "30d"), E.current_vs_prior, E.category_deltas,
    G.monthly_averages, G.category_monthly_spend, G.top_levers])
def test_reports_sum_to_days_before_anything_else(spark, ledger, tmp_path, report):
    """One scan, no join, and the first exchange is dealt by day, not by account alone."""
    ledger(skewed_rows(500)).write.parquet(str(tmp_path / "l"))
    plan = report(spark.read.parquet(str(tmp_path / "l")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "Join" not in plan
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert "txn_date" in exchanges[-1]
