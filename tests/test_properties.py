"""Property checks (hypothesis, few examples: every example runs Spark jobs)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerspark.operators import periods as E
from ledgerspark.operators import savings as G

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

row = st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 120),
                st.integers(-50000, 50000), st.sampled_from(["Coffee", "Travel", "Income", "Rent"]))


def to_ledger(ledger, rows):
    base = dt.date(2024, 1, 1)
    return ledger([(a, (base + dt.timedelta(days=d)).isoformat(), "X", c / 100.0,
                    "Income" if c > 0 else (cat if cat != "Income" else "Misc"))
                   for a, d, c, cat in rows])


@SETTINGS
@given(rows=st.lists(row, min_size=1, max_size=40), period=st.sampled_from(["14d", "30d", "90d"]))
def test_series_calendar_and_running_total(spark, ledger, rows, period):
    t = to_ledger(ledger, rows)
    series = E.daily_series(t, period).collect()
    summ = {r.account_id: r for r in E.series_summary(t, period).collect()}
    for acct, s in summ.items():
        pts = sorted((r for r in series if r.account_id == acct), key=lambda r: r.date)
        assert len(pts) == E.SERIES_DAYS[period] + 1 == s.data_points
        assert [p.date for p in pts] == [pts[0].date + dt.timedelta(days=i) for i in range(len(pts))]
        assert abs(pts[-1].cumulative_income - s.total_income) < 1e-6
        assert abs(pts[-1].cumulative_spending - s.total_spending) < 1e-6


@SETTINGS
@given(rows=st.lists(row, min_size=1, max_size=40), target=st.integers(1, 100000),
       months=st.integers(1, 24))
def test_cuts_never_exceed_shortfall(spark, ledger, rows, target, months):
    t = to_ledger(ledger, rows)
    goals = spark.createDataFrame([("g", "a", float(target), months)],
                                  "goal_id string, account_id string, target_amount double, months int")
    for r in G.analyze_goals(t, goals).collect():
        total = sum(c.reduction_amount for c in r.cuts)
        assert total <= r.shortfall + 1e-6
        assert abs(r.total_suggested_savings - total) < 1e-6
        assert r.remaining_shortfall >= -1e-9
        keys = [(c.priority, -c.current_monthly) for c in r.cuts]
        assert keys == sorted(keys)                                  # plan order
        assert all(c.reduction_percentage > 5 for c in r.cuts)
