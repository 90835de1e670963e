"""Subscription features against a brute-force per-group computation of the
same definitions (dense daily calendar, numpy statistics), model training
and scoring on a ledger with recurring merchants, costs and websites."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import insights as N
from ledgerspark.operators import subscriptions as S
from ledgerspark.operators import websites as W


def brute_features(rows):
    """rows: list of (date, amount) of one group -> dict of features."""
    rows = sorted(rows)
    dates = [r[0] for r in rows]
    n = len(rows)
    if n >= 2:
        gaps = np.array([(b - a).days for a, b in zip(dates, dates[1:])], dtype=float)
        mean = gaps.mean()
        gap_cv = (gaps.std(ddof=1) / mean if len(gaps) > 1 else float("nan")) if mean else 1.0
        median_gap = float(np.median(gaps))
        span = (dates[-1] - dates[0]).days
    else:
        gap_cv, median_gap, span = 1.0, 0.0, 0
    amt = np.array([r[1] for r in rows if r[1] is not None], dtype=float)
    am = float(amt.mean()) if len(amt) else 0.0
    acv = float(amt.std(ddof=1) / abs(am)) if len(amt) > 1 and abs(am) > 1e-9 else 0.0
    if len(amt) >= 4 and abs(am) > 1e-9:
        q1, q3 = np.percentile(amt, [25, 75])
        iqr = float((q3 - q1) / abs(am))
    else:
        iqr = 0.0
    months = len({(d.year, d.month) for d in dates})
    doms = [d.day for d in dates]
    counts = {x: doms.count(x) for x in set(doms)}
    mode = min(k for k, v in counts.items() if v == max(counts.values()))
    cal = np.zeros(span + 1)
    for d in dates:
        cal[(d - dates[0]).days] = 1.0
    if len(cal) <= 30:
        ac = 0.0
    else:
        x0, x1 = cal[:-30], cal[30:]
        ac = 0.0 if x0.std() == 0 or x1.std() == 0 else float(np.corrcoef(x0, x1)[0, 1])
    neg = sum(1 for r in rows if r[1] is not None and r[1] < 0) / n
    return dict(n_occurrences=n, coverage_months=months, median_gap_days=median_gap,
                gap_cv=gap_cv, day_of_month_mode=mode, dom_consistency=counts[mode] / n,
                amount_mean=am, amount_cv=acv, amount_iqr_ratio=iqr, autocorr_30d=ac,
                share_negative=neg, span_days=span)


def random_ledger(seed, n_groups=40):
    rnd = random.Random(seed)
    rows = []
    for g in range(n_groups):
        acct, merch = f"acct{g % 3}", f"SHOP {g}"
        start = dt.date(2023, 1, 1) + dt.timedelta(days=rnd.randint(0, 200))
        kind = g % 4
        size = rnd.choice([1, 2, 3, 5, 12, 40])
        for i in range(size):
            if kind == 0:      # monthly with jitter
                day = start + dt.timedelta(days=30 * i + rnd.randint(-2, 2))
            elif kind == 1:    # same-day repeats
                day = start + dt.timedelta(days=rnd.randint(0, 3))
            else:
                day = start + dt.timedelta(days=rnd.randint(0, 400))
            amt = rnd.choice([-15.49, -15.49, -9.99, 0.0, -round(rnd.uniform(1, 300), 2), None])
            rows.append((acct, day, merch, amt))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_features_match_brute_force(spark, ledger, seed):
    rows = random_ledger(seed)
    t = ledger([(a, d.isoformat(), m, amt, "Misc") for a, d, m, amt in rows])
    got = {(r.account_id, r.merchant): r.asDict()
           for r in S.merchant_features(S.expense_projection(t)).collect()}
    groups = {}
    for a, d, m, amt in rows:
        if amt is not None and amt <= 0:                   # expense projection
            groups.setdefault((a, m), []).append((d, amt))
    assert set(got) == set(groups)
    for key, g in groups.items():
        exp = brute_features(g)
        for k, v in exp.items():
            gv = got[key][k]
            if isinstance(v, float) and math.isnan(v):
                assert gv is None, (key, k)
            else:
                assert gv == pytest.approx(v, abs=2e-6), (key, k, gv, v)


def test_autocorr_set_form_on_monthly(spark, ledger):
    rows = [("a", (dt.date(2024, 1, 15) + dt.timedelta(days=30 * i)).isoformat(), "NETFLIX", -15.49, "X")
            for i in range(12)]
    f = S.merchant_features(S.expense_projection(ledger(rows))).first()
    assert f.autocorr_30d == pytest.approx(1.0)
    assert f.median_gap_days == 30.0 and f.gap_cv == 0.0 and f.amount_cv == 0.0


def fixture_ledger(ledger, accounts=6):
    """Recurring merchants (monthly, 1-2 days of jitter) among irregular ones."""
    rnd = random.Random(7)
    rows = []
    subs = [("NETFLIX", -15.49), ("SPOTIFY", -10.99), ("ICLOUD", -2.99), ("CITY GYM", -39.99)]
    others = ["SAFEWAY", "SHELL GAS", "TARGET", "CHIPOTLE", "UBER TRIP", "STARBUCKS", "AMAZON MKTPLACE"]
    for a in range(accounts):
        for name, amt in subs:
            for mth in range(12):
                day = dt.date(2024, 1, 1) + dt.timedelta(days=30 * mth + rnd.randint(0, 2))
                rows.append((f"acct{a}", day.isoformat(), name, amt, "Misc"))
        for name in others:
            for _ in range(rnd.randint(4, 25)):
                day = dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 360))
                rows.append((f"acct{a}", day.isoformat(), name, -round(rnd.uniform(3, 120), 2), "Misc"))
        rows.append((f"acct{a}", "2024-06-01", "SALARY", 3000.0, "Income"))
    return ledger(rows)


def test_train_score_costs_totals(spark, ledger, tmp_path):
    t = fixture_ledger(ledger)
    exp = S.expense_projection(t)
    feats = S.label_known(S.merchant_features(exp))
    model, metrics = S.train_subscription_model(feats)
    assert set(metrics) == {"auc", "precision", "recall", "f1"}
    scored = S.score_subscriptions(feats, model)
    top = {r.merchant: r.score for r in scored.filter(F.col("account_id") == "acct0").collect()}
    assert min(top[m] for m in ["NETFLIX", "SPOTIFY", "ICLOUD", "CITY GYM"]) > \
        max(top[m] for m in ["SAFEWAY", "TARGET", "CHIPOTLE"])
    path = str(tmp_path / "model")
    S.save_model(model, path)
    again = S.score_subscriptions(feats, S.load_model(path))
    assert sorted(r.score for r in again.collect()) == pytest.approx(sorted(r.score for r in scored.collect()))
    costs = {r.merchant: r for r in S.monthly_cost(scored).filter(F.col("account_id") == "acct0").collect()}
    nf = costs["NETFLIX"]
    assert nf.average_monthly_cost == round(15.49 * nf.n_occurrences / nf.coverage_months, 2)
    tot = S.subscription_totals(scored, exp, threshold=0.5).filter(F.col("account_id") == "acct0").first()
    assert tot.total_subscriptions >= 4
    assert tot.total_yearly_cost == pytest.approx(round(tot.total_monthly_cost * 12, 2))
    # The same model on each account's last 30 days, fed to the facts
    recent = N.recent_subscriptions(t, model, threshold=0.0)
    assert set(recent.columns) == {"account_id", "merchant", "score", "amount_mean", "n_occurrences"}
    monthly = recent.filter(F.col("merchant").isin("NETFLIX", "SPOTIFY", "ICLOUD", "CITY GYM"))
    assert monthly.count() > 0
    assert monthly.filter(F.col("n_occurrences") > 2).count() == 0   # <= 2 monthly charges in 30 days
    facts = N.insight_facts(t, recent).filter(F.col("account_id") == "acct0").first()
    assert 0 < len(facts.subs_summary) <= 6
    scores = [x.score for x in facts.subs_summary]
    assert scores == sorted(scores, reverse=True)


@pytest.mark.parametrize("n_pos,n_neg,holdout", [(1, 1, 0.3), (2, 9, 0.3), (50, 951, 0.3), (7, 400, 0.0)])
def test_holdout_is_an_exact_share_of_each_label(spark, n_pos, n_neg, holdout):
    df = spark.range(n_pos + n_neg).selectExpr("string(id % 3) AS account_id", "string(id) AS merchant",
                                               f"double(id < {n_pos}) AS label")
    got = {(r.label, r._holdout): r["count"] for r in S._split_flag(df, 42, holdout).groupBy("label", "_holdout").count().collect()}
    for label, n in ((1.0, n_pos), (0.0, n_neg)):
        want = 0 if n < 2 else max(1, min(n - 1, int(n * holdout + 0.5)))
        assert got.get((label, True), 0) == want and got.get((label, False), 0) == n - want


def test_single_class_raises(spark, ledger):
    rows = [("a", f"2024-0{i}-01", "SHOP", -5.0, "Misc") for i in range(1, 6)]
    feats = S.label_known(S.merchant_features(S.expense_projection(ledger(rows))))
    with pytest.raises(ValueError):
        S.train_subscription_model(feats)


WEBSITES = [
    ("NETFLIX", "https://netflix.com"),
    ("NETFLIXCOM", "https://netflix.com"),
    ("AMAZON MKTPLACE", "https://amazon.com/prime"),     # site word AMAZON in the name
    ("MSFT", None),                                      # alias key MICROSOFT is not a site
    ("GCP", "https://cloud.google.com"),                 # alias of GOOGLE CLOUD
    ("A", "https://amazon.com/prime"),                   # merchant word inside a site name
    ("", None),
    ("ZZZZ", None),
    (None, None),
    ("  hulu  ", "https://hulu.com"),
]


def plain_website(merchant):
    """The three rules tried one after the other on one merchant."""
    if not merchant:
        return None
    name, url_of = merchant.strip().upper(), dict(W.SUBSCRIPTION_WEBSITES)
    if name in url_of:
        return url_of[name]
    for known, url in W.SUBSCRIPTION_WEBSITES:
        if any(w in name for w in known.split()) or any(w in known for w in name.split()):
            return url
    return next((url_of.get(known) for known, aliases in W.WEBSITE_ALIASES if any(a in name for a in aliases)), None)


def test_websites(spark):
    rng = random.Random(8)
    words = [w for k, _ in W.SUBSCRIPTION_WEBSITES for w in k.split()] + [a for _, v in W.WEBSITE_ALIASES for a in v]
    some = []
    for _ in range(300):
        w = rng.choice(words)
        cut = w[rng.randint(0, 2):rng.randint(2, len(w) + 1)]
        some.append(rng.choice([w, cut, "X" + w + "Y", f"{cut} {rng.choice(words)[:3]}", "QZJ " + w.lower(), "QXZJ"]))
    rows = [m for m, _ in WEBSITES] + some
    df = spark.createDataFrame([(k, m, "clash") for k, m in enumerate(rows)], "id int, merchant string, url string")
    out = W.attach_website(df)
    got = {r.id: r.website for r in out.collect()}
    assert out.columns == ["id", "merchant", "url", "website"] and len(got) == len(rows)
    for k, m in enumerate(rows):
        assert got[k] == plain_website(m), m
    assert [got[k] for k in range(len(WEBSITES))] == [u for _, u in WEBSITES]
