"""A description is normalised once, not once for each pass over the expenses."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.operators import subscriptions as S
from ledgerspark.plans import registry

LEDGER = "account_id string, txn_date date, description string, amount decimal(18,2), category string, confidence double"


def watched_ledger(spark):
    """A ledger, its number of expenses, and a count of the descriptions that are computed."""
    rows = [(f"a{a}", dt.date(2024, 1, 1) + dt.timedelta(days=11 * k + a + len(name)), name, Decimal(-5 - k - a), "Misc", 1.0)
            for a in range(4) for name in ("red wine", "brass nails", "shop", "rent & co", "gas") for k in range(6)]
    rows.append(("a0", None, "red wine", Decimal(-1), "Misc", 1.0))
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x
    t = spark.createDataFrame(rows, LEDGER).repartition(3)
    return t.withColumn("description", F.udf(told, T.StringType()).asNondeterministic()("description")), len(rows), seen


def test_features_normalise_each_row_once(spark):
    t, n, seen = watched_ledger(spark)
    assert S.merchant_features(S.expense_projection(t)).count() == 20
    assert 0 < seen.value <= n


def test_scores_compute_the_features_once(spark, monkeypatch):
    t, n, seen = watched_ledger(spark)
    monkeypatch.setattr(registry, "_ledger", lambda *_: t)
    got = registry.subscription_scores(spark, "unused").collect()
    assert len(got) == 20 and all(0 <= r.score <= 1 for r in got)
    assert {r.merchant for r in got} == {"RED WINE", "BRASS NAILS", "SHOP", "RENT & CO", "GAS"}
    assert 0 < seen.value <= n
