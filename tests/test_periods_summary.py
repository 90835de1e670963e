"""Hand-checked answers for the period reports (E) and account summary (D)."""

from pyspark.sql import functions as F

from ledgerspark.operators import periods as E
from ledgerspark.operators import summary as D

ROWS = [
    # account a: latest date 2024-03-31
    ("a", "2024-03-31", "COFFEE", -5.00, "Coffee"),
    ("a", "2024-03-31", "SALARY", 3000.00, "Income"),
    ("a", "2024-03-02", "COFFEE", -7.00, "Coffee"),      # max-29: current window start
    ("a", "2024-03-01", "BOOKS", -20.00, "Shopping"),    # max-30: prior window
    ("a", "2024-02-02", "BOOKS", -30.00, "Shopping"),    # max-58: prior window start
    ("a", "2024-02-01", "RENT", -900.00, "Rent"),        # max-59: outside both
    ("a", "2024-03-15", "COFFEE", None, "Coffee"),       # NULL amount
    # account b: one row
    ("b", "2024-01-10", "TEA", -3.00, "Coffee"),
]


def by_key(rows, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}


def test_window_offsets(spark, ledger):
    t = ledger(ROWS)
    cat = by_key(E.categories_by_period(t, "30d").collect(), "account_id", "category")
    # 30d category report: [max-29, max] -> 2024-03-02 .. 03-31
    assert cat[("a", "Coffee")].total_amount == 12.0
    assert cat[("a", "Coffee")].transaction_count == 2           # NULL amount row dropped
    assert ("a", "Shopping") not in cat
    # series report: [max-30, max] -> includes 03-01, 31 calendar days
    s = [r for r in E.daily_series(t, "30d").collect() if r.account_id == "a"]
    assert len(s) == 31
    assert s[0].date.isoformat() == "2024-03-01" and s[0].daily_spending == 20.0
    last = max(s, key=lambda r: r.date)
    assert last.cumulative_spending == 32.0 and last.cumulative_income == 3000.0
    summ = by_key(E.series_summary(t, "30d").collect(), "account_id")
    assert summ["a"].data_points == 31 and summ["a"].net_amount == 3000.0 - 32.0


def test_category_min_max_semantics(spark, ledger):
    t = ledger(ROWS)
    r = by_key(E.categories_by_period(t, "30d").collect(), "account_id", "category")[("a", "Coffee")]
    # amounts are negative: min_amount = |most negative| = the larger absolute value
    assert r.min_amount == 7.0 and r.max_amount == 5.0 and r.average_amount == 6.0
    assert r.percentage_of_spending == 100.0


def test_current_vs_prior_and_deltas(spark, ledger):
    t = ledger(ROWS)
    cp = by_key(E.current_vs_prior(t).collect(), "account_id")["a"]
    assert cp.current_income == 3000.0 and cp.current_expenses == 12.0
    # prior = [max-58, max-29): 02-02 .. 03-01 (29 days)
    assert cp.prior_expenses == 50.0 and cp.prior_net == -50.0
    assert cp.net_change == (3000.0 - 12.0) - (-50.0)
    deltas = by_key(E.category_deltas(t).collect(), "account_id", "category")
    assert set(deltas) == {("a", "Coffee"), ("b", "Coffee")}        # only categories present now
    assert deltas[("a", "Coffee")].prior_amount == 0.0


def test_top_merchants_counts_spending_sums_all(spark, ledger):
    rows = [("a", "2024-03-30", "SHOP", -10.0, "Shopping"),
            ("a", "2024-03-30", "SHOP", 4.0, "Income"),         # refund counted in the amount
            ("a", "2024-03-29", "SHOP", -10.0, "Shopping"),
            ("a", "2024-03-29", "CAFE", -3.0, "Coffee")]
    got = by_key(E.top_merchants(ledger(rows), 5).collect(), "merchant")
    assert got["SHOP"]["count"] == 2 and got["SHOP"].total_amount == 16.0 and got["SHOP"]["rank"] == 1
    assert got["CAFE"]["rank"] == 2


def test_largest_day_lookup_share(spark, ledger):
    t = ledger(ROWS)
    big = by_key(E.largest_spending_day(E.daily_series(t, "90d")).collect(), "account_id")
    assert big["a"].date.isoformat() == "2024-02-01" and big["a"].amount == 900.0
    look = by_key(E.category_spend_lookup(t, "Coffee", "30d").collect(), "account_id")
    assert look["a"].amount == 12.0
    look = by_key(E.category_spend_lookup(t, "Rent", "30d").collect(), "account_id")
    assert look["a"].amount == 0.0
    top = E.top_categories(E.categories_by_period(t, "1y"), 10)
    sh = by_key(E.share_of_total(top).collect(), "account_id", "category")
    assert abs(sum(r.share_pct for k, r in sh.items() if k[0] == "a") - 100.0) < 1e-9


def test_account_totals_and_breakdown(spark, ledger):
    t = ledger(ROWS)
    a = by_key(D.account_totals(t).collect(), "account_id")["a"]
    assert a.total_transactions == 7                       # NULL amount counted as a row
    assert a.total_income == 3000.0 and a.total_expenses == 962.0
    assert a.average_transaction == (3000.0 - 962.0) / 6
    b = by_key(D.category_breakdown(t).collect(), "account_id", "category")
    assert b[("a", "Coffee")].transaction_count == 3 and b[("a", "Coffee")].average_amount == -6.0


def test_period_sum_gates_and_week_label(spark, ledger):
    rows = [("a", f"2024-01-{i:02d}", "X", -1.0, "Misc") for i in range(1, 9)]      # 8 rows
    rows += [("b", f"2024-01-{i:02d}", "X", -1.0, "Misc") for i in range(1, 8)]     # 7 rows
    s = D.period_sums(ledger(rows)).collect()
    grains = {(r.account_id, r.grain) for r in s}
    assert ("a", "weekly") in grains and ("b", "weekly") not in grains
    assert ("a", "monthly") not in grains
    weeks = sorted(r.period for r in s if r.account_id == "a" and r.grain == "weekly")
    assert weeks == ["2024-01-01/2024-01-07", "2024-01-08/2024-01-14"]


def test_trend_collapses_gaps(spark, ledger):
    # monthly income 100, 200, (gap), 400 -> x = 0,1,2 -> slope of (100,200,400)
    rows = [("a", f"2024-{mth:02d}-05", "PAY", amt, "Income") for mth, amt in
            [(1, 100.0), (2, 200.0), (4, 400.0)]]
    rows += [("a", f"2024-{(i % 4) + 1:02d}-{(i % 27) + 1:02d}", "X", -1.0, "Misc") for i in range(30)]
    tr = D.trend(D.period_sums(ledger(rows))).first()
    assert tr.grain == "monthly"
    assert abs(tr.income_trend - 150.0) < 1e-9 and tr.income_trend_direction == "increasing"


def test_confidence_stats_edges(spark, ledger):
    rows = [("a", "2024-01-01", "X", -1.0, "Misc", 0.5),
            ("b", "2024-01-01", "PAY", 10.0, "Income", 1.0)]
    c = by_key(D.confidence_stats(ledger(rows)).collect(), "account_id")
    assert c["a"].std_confidence is None and c["a"].median_confidence == 0.5   # one row
    assert c["b"].mean_confidence == 0.0 and c["b"].std_confidence == 0.0       # none


def test_data_quality_duplicates_with_nulls(spark, ledger):
    rows = [("a", None, None, -1.0, "Misc"), ("a", None, None, -1.0, "Misc"),
            ("a", "2024-01-01", "X", -1.0, "Misc")]
    q = D.data_quality(ledger(rows)).first()
    assert q.duplicate_rows == 1 and q.null_txn_date == 2 and q.null_description == 2
    assert q.columns_with_all_nulls == 0


def test_distribution_and_uncategorized(spark, ledger):
    rows = [("a", "2024-01-01", "X", -1.0, "Uncategorized"), ("a", "2024-01-02", "Y", -1.0, "Misc"),
            ("a", "2024-01-03", "Z", -1.0, "Misc"), ("a", "2024-01-04", "P", 5.0, "Income")]
    t = ledger(rows)
    u = D.uncategorized_rate(t).first()
    assert u.uncategorized_count == 1 and abs(u.uncategorized_percentage - 100 / 3) < 1e-9
    dist = by_key(D.category_distribution(t).collect(), "category")
    assert dist["Misc"].percentage == 50.0 and dist["Misc"].unique_categories == 3
    top = D.top_categories_by_count(t).collect()
    assert [r.category for r in sorted(top, key=lambda r: r["rank"])] == ["Misc", "Uncategorized"]


def test_partition_invariance(spark, ledger):
    t = ledger(ROWS)
    a = sorted(map(tuple, E.categories_by_period(t.repartition(1), "1y").collect()))
    b = sorted(map(tuple, E.categories_by_period(t.repartition(7, "txn_date"), "1y").collect()))
    assert a == b
    assert t.select(F.count("*")).first()[0] == len(ROWS)
