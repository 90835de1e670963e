"""Savings goals, net-worth projection and the money-priority plan."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import networth as H
from ledgerspark.operators import priorities as I
from ledgerspark.operators import savings as G

# ---------------------------------------------------------------------------
# savings
# ---------------------------------------------------------------------------


def test_cut_priority_and_greedy_skip(spark, ledger):
    # last 90 days (from 2024-03-31): monthly = |sum| / 3
    rows = [("a", "2024-03-31", "PAY", 3000.0, "Income"),
            ("a", "2024-03-30", "X", -1500.0, "Entertainment"),     # 500/month, priority 1
            ("a", "2024-03-29", "X", -2700.0, "Restaurants"),       # 900/month, amount rule -> 2
            ("a", "2024-03-28", "X", -300.0, "Groceries"),          # 100/month, priority 2
            ("a", "2024-03-27", "X", -3.0, "Misc")]                 # 1/month, amount rule -> 4
    t = ledger(rows)
    spend = {r.category: r for r in G.category_monthly_spend(t).collect()}
    assert spend["Entertainment"].priority == 1 and spend["Restaurants"].priority == 2
    assert spend["Groceries"].priority == 2 and spend["Misc"].priority == 4
    goals = spark.createDataFrame([("g1", "a", 30000.0, 12)],
                                  "goal_id string, account_id string, target_amount double, months int")
    r = G.analyze_goals(t, goals).first()
    # income 1000/month, expenses 1501/month, net -501; target 2500 -> shortfall 3001
    assert r.monthly_savings == pytest.approx(1000.0 - 1501.0)
    assert r.shortfall == pytest.approx(2500.0 + 501.0)
    cuts = [(c.category, round(c.reduction_amount, 6)) for c in r.cuts]
    # order: p1 Entertainment (50%), p2 Restaurants 900 (30%), p2 Groceries 100 (30%), p4 Misc (10%)
    assert cuts == [("Entertainment", 250.0), ("Restaurants", 270.0), ("Groceries", 30.0),
                    ("Misc", 0.1)]
    assert r.total_suggested_savings == pytest.approx(550.1)
    assert r.high_priority_cuts == 1 and not r.achievable_with_cuts
    # remaining 2450.9 / 12 months > 200 -> 2 + 2 strategies
    assert len(r.alternative_strategies) == 4


def test_small_cut_is_skipped_not_stopped(spark, ledger):
    rows = [("a", "2024-03-31", "PAY", 30000.0, "Income"),
            ("a", "2024-03-30", "X", -30000.0, "Entertainment"),     # 10000/month
            ("a", "2024-03-29", "X", -30.0, "Travel")]               # 10/month
    goals = spark.createDataFrame([("g", "a", 1200.0, 1)],
                                  "goal_id string, account_id string, target_amount double, months int")
    r = G.analyze_goals(ledger(rows), goals).first()
    # shortfall 1200 - (10000 - 10000 - 10) = 1210: Entertainment pct = 0.121 -> taken
    assert [c.category for c in r.cuts] == ["Entertainment"]
    assert r.remaining_shortfall == pytest.approx(0.0)


def test_goal_without_data(spark, ledger):
    t = ledger([("a", "2024-01-01", "X", -5.0, "Misc")])
    goals = spark.createDataFrame([("g", "zz", 1000.0, 4)],
                                  "goal_id string, account_id string, target_amount double, months int")
    r = G.analyze_goals(t, goals).first()
    assert r.shortfall == 250.0 and r.remaining_shortfall == 250.0 and not r.can_achieve_goal
    assert r.alternative_strategies == [G.NO_DATA_MESSAGE] and r.cuts == []


def test_top_levers_exclude_rent_like(spark, ledger):
    rows = [("a", "2024-03-31", "X", -900.0, "Rent"), ("a", "2024-03-30", "X", -50.0, "Parents"),
            ("a", "2024-03-30", "X", -80.0, "Dining"), ("a", "2024-03-30", "X", -60.0, "Travel"),
            ("a", "2024-03-30", "X", -40.0, "Gas"), ("a", "2024-03-30", "X", -30.0, "Fees"),
            ("a", "2024-03-30", "PAY", 100.0, "Income")]
    lv = G.top_levers(ledger(rows)).orderBy("rank").collect()
    assert [r.category for r in lv] == ["Dining", "Travel", "Gas"]
    assert lv[0].suggested_reduction == pytest.approx(16.0) and lv[0].new_spending == pytest.approx(64.0)
    s = G.lever_savings(G.top_levers(ledger(rows))).first()
    assert s.monthly_savings == pytest.approx(0.2 * (80 + 60 + 40))


# ---------------------------------------------------------------------------
# net worth
# ---------------------------------------------------------------------------

RATES = dict(H.RATE_DEFAULTS)
FULL = dict(zip(H.BALANCES, [500000, 5000, 25000, 100000, 30000, 10000, 300000, 5000, 0, 20000, 15000, 0]),
            **dict(zip(H.FLOWS, [2000, 1000, 1500, 500, 2000, 500, 0, 300, 400, 0])))
MINIMAL = dict(zip(H.BALANCES, [0, 10000, 5000, 0, 0, 0, 0, 2000, 0, 0, 0, 0]),
               **dict(zip(H.FLOWS, [1000, 500, 0, 0, 0, 200, 0, 0, 0, 0])))
# auto-move larger than the contribution (checking runs dry), payment below
# interest, zero rate with a payment
DRY = dict(zip(H.BALANCES, [0, 1000, 0, 0, 0, 0, 0, 10000, 0, 0, 0, 500]),
           **dict(zip(H.FLOWS, [100, 0, 0, 400, 0, 50, 0, 0, 0, 100])))


def loop(h, months):
    """Plain month loop of the projection rules (scalar Python)."""
    r = {c: (1.0 + RATES[rate] / 100.0) ** (1.0 / 12.0) - 1.0
         for c, rate in {**H._ASSET_RATE, **H._DEBT_RATE}.items()}
    b = {c: float(h[c]) for c in H.BALANCES}
    out = [dict(b)]
    for _ in range(months):
        b["checking"] += h["contrib_checking"]
        b["savings_hysa"] += h["contrib_hysa"]
        b["retirement_invest"] += h["contrib_retirement"]
        mv = min(h["move_checking_to_invest"], max(0.0, b["checking"]))
        b["checking"] -= mv
        b["retirement_invest"] += mv
        for c in H._ASSET_RATE:
            b[c] *= (1.0 + r[c])
        b["cars_value"] = max(0.0, b["cars_value"])
        for c in H.DEBTS:
            b[c] *= (1.0 + r[c])
            p = h[H._DEBT_PAY[c]]
            if not (b[c] <= 0.0 or p <= 0.0):
                b[c] = max(0.0, b[c] - p)
        out.append(dict(b))
    return out


@pytest.mark.parametrize("name,h", [("full", FULL), ("minimal", MINIMAL), ("dry", DRY)])
def test_projection_matches_loop(spark, name, h):
    df = spark.createDataFrame([{"account_id": name, **{k: float(v) for k, v in h.items()}}])
    got = {r.t: r for r in H.project_net_worth(df, 240, start_month="2024-01").collect()}
    exp = loop(h, 240)
    for t in (0, 1, 2, 12, 37, 240):
        for c in H.BALANCES:
            assert got[t][c] == pytest.approx(exp[t][c], abs=0.006), (t, c)
        nw = sum(exp[t][c] for c in H.ASSETS) - sum(exp[t][c] for c in H.DEBTS)
        assert got[t].net_worth == pytest.approx(nw, abs=0.006)
    assert got[13].month == "2025-02"
    if name == "dry":
        assert got[240].checking == 0.0                   # moved out faster than paid in
        assert got[240].other_debt == pytest.approx(0.0)  # zero rate, paid off by 100/month


def test_horizons_and_flows(spark):
    df = spark.createDataFrame([{"account_id": "x", **{k: float(v) for k, v in FULL.items()}}])
    hz = {r.horizon: r for r in H.horizons(df, "2024-01").collect()}
    assert set(hz) == set(H.HORIZONS)
    cur = sum(FULL[c] for c in H.ASSETS) - sum(FULL[c] for c in H.DEBTS)
    assert hz["1y"].current_net_worth == cur
    assert hz["1y"].net_worth_change == pytest.approx(hz["1y"].net_worth - cur)
    f = H.flow_summary(df).first()
    assert f.total_contributions_monthly == 4500 and f.total_debt_payments_monthly == 3200
    assert f.display_contributions_monthly == 5000


def test_optimized_growth_and_downsample(spark):
    df = spark.createDataFrame([{"account_id": "x", **{k: float(v) for k, v in FULL.items()}}])
    sav = spark.createDataFrame([("x", 100.0)], "account_id string, monthly_savings double")
    o = {r.horizon: r for r in H.optimized_projection(df, sav, "2024-01").collect()}
    assert o["10y"].improvement > o["1y"].improvement > 0
    g = H.growth_stats(df, sav, 60, "2024-01").first()
    assert g.savings_improvement == pytest.approx(o["5y"].improvement)
    assert [H.downsample_step(m) for m in (12, 24, 60, 120, 240, 600)] == [1, 1, 2, 4, 4, 10]
    ds = {r.t: r for r in H.downsample(H.project_net_worth(df, 240, start_month="2024-01"), 240).collect()}
    assert sorted(ds) == list(range(0, 241, 4))
    assert ds[0].label == "Jan 2024" and ds[4].label == "May 2024" and ds[240].label == "Jan 2044"


# ---------------------------------------------------------------------------
# money-priority plan
# ---------------------------------------------------------------------------

ANSWERS = "account_id string, total_debt double, highest_apr double, minimum_payments double, " \
          "debt_accounts double, current_emergency_fund double, employer_match_percentage double, " \
          "match_limit double, current_contribution double, salary double, risk_tolerance double, " \
          "investment_experience double, preferred_retirement_account string, hysa_rate double"


def test_priority_plan_base_and_no_debt(spark):
    answers = spark.createDataFrame([
        ("base", 5000.0, 22.99, 150.0, 3.0, 1000.0, 4.0, 6.0, 2.0, 60000.0, 3.0, 2.0, "401k", 4.5),
        ("nodebt", 0.0, 0.0, 0.0, 0.0, 2000.0, 4.0, 6.0, 4.0, 75000.0, 4.0, 3.0, "both", 4.5)], ANSWERS)
    disc = spark.createDataFrame([("base", 1000.0, 2000.0, 12000.0), ("nodebt", 1000.0, 300.0, 1800.0)],
                                 "account_id string, discretionary_income double, monthly_expenses double, "
                                 "six_month_expenses double")
    plan = {r.account_id: r for r in I.priority_plan(answers, disc).collect()}
    b = {p.priority: p for p in plan["base"].priorities}
    assert b[1].monthly_allocation == 150 + 800 and b[1].months_to_complete == pytest.approx(5000 / 950)
    assert b[2].monthly_allocation == pytest.approx(min(600, 11000 / 12))
    assert b[3].monthly_allocation == pytest.approx(60000 / 12 * 0.02) and b[3].months_to_complete == 1
    assert b[4].monthly_allocation == pytest.approx(1000 - 950 - 600 - 100)
    assert plan["base"].remaining_discretionary == pytest.approx(0.0)
    assert len(b[1].recommendations) == 4 and b[1].recommendations[0].startswith("Pay $950.00 monthly")
    n = {p.priority: p for p in plan["nodebt"].priorities}
    assert n[1].status == "completed" and n[1].months_to_complete == 0.0   # 0 / 0: nothing owed
    assert n[2].status == "completed" and n[3].status == "completed"
    assert n[4].months_to_complete is None and len(n[4].recommendations) == 6
    rows = I.priority_rows(I.priority_plan(answers, disc))
    assert rows.count() == 8 and rows.filter(F.col("priority") == 4).count() == 2
