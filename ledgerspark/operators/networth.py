"""Net worth: current value, month-by-month projection, horizons, optimised
scenario (H1-H10). Input is a table of households (one row each: 12 balances,
11 yearly rates in percent, 10 monthly flows).

The projection is a per-household recurrence with floors (checking can run
dry, debts stop at zero, cars never go negative). Its floating-point result
must match the month loop to the cent, which a closed form does not, so the
loop runs in ``mapInArrow``: numpy arrays over a batch of households, one
vectorised step per month. No shuffle is needed -- households are independent
and stay in the partition they were read in -- and only the requested months
are emitted (e.g. 7 horizon rows instead of 601). Rounding, calendar labels
and every comparison run back in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_cents

# ---------------------------------------------------------------------------
# Column names, default yearly rates (percent; every caller of
# the reference passes 6.0 for the mortgage), horizons in months.
# ---------------------------------------------------------------------------
ASSETS = ["real_estate", "checking", "savings_hysa", "retirement_invest", "cars_value",
          "other_assets"]
DEBTS = ["real_estate_loans", "credit_card_debt", "personal_loans", "student_loans",
         "car_loans", "other_debt"]
BALANCES = ASSETS + DEBTS
RATE_DEFAULTS = {
    "real_estate_apr": 3.5, "hysa_apr": 2.0, "retirement_apr": 10.0, "cars_apr": -10.0,
    "other_assets_apr": 0.0, "mortgage_apr": 6.0, "cc_apr": 22.0, "personal_apr": 12.0,
    "student_apr": 7.0, "car_apr": 9.0, "other_debt_apr": 0.0,
}
CONTRIBUTIONS = ["contrib_checking", "contrib_hysa", "contrib_retirement"]
PAYMENTS = ["pay_mortgage", "pay_cc", "pay_personal", "pay_student", "pay_car", "pay_other_debt"]
FLOWS = CONTRIBUTIONS + ["move_checking_to_invest"] + PAYMENTS
HORIZONS = {"3m": 3, "1y": 12, "2y": 24, "5y": 60, "10y": 120, "20y": 240, "50y": 600}

# balance -> rate column; debt -> payment column
_ASSET_RATE = {"real_estate": "real_estate_apr", "savings_hysa": "hysa_apr",
               "retirement_invest": "retirement_apr", "cars_value": "cars_apr",
               "other_assets": "other_assets_apr"}
_DEBT_RATE = {"real_estate_loans": "mortgage_apr", "credit_card_debt": "cc_apr",
              "personal_loans": "personal_apr", "student_loans": "student_apr",
              "car_loans": "car_apr", "other_debt": "other_debt_apr"}
_DEBT_PAY = dict(zip(DEBTS, PAYMENTS))


def _sum_cols(cols: Sequence[str]):
    expr = F.col(cols[0])
    for c in cols[1:]:
        expr = expr + F.col(c)
    return expr


# ---------------------------------------------------------------------------
# H1-H3
# ---------------------------------------------------------------------------

def with_defaults(h: DataFrame) -> DataFrame:
    """H2: missing balances/flows -> 0, missing rates -> the default rates."""
    out = h
    for c in BALANCES + FLOWS:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                             if c in h.columns else F.lit(0.0))
    for c, d in RATE_DEFAULTS.items():
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(d))
                             if c in h.columns else F.lit(d))
    return out


def net_worth(h: DataFrame) -> DataFrame:
    """H1: assets, liabilities and net worth of the starting balances."""
    return (h.withColumn("assets_total", _sum_cols(ASSETS))
             .withColumn("liabilities_total", _sum_cols(DEBTS))
             .withColumn("net_worth", _sum_cols(ASSETS) - _sum_cols(DEBTS)))


def monthly_rate(apr):
    """H3: effective monthly rate of a yearly percent rate (numpy or Column)."""
    if isinstance(apr, (np.ndarray, float, int)):
        return (1.0 + np.asarray(apr, dtype=float) / 100.0) ** (1.0 / 12.0) - 1.0
    return F.pow(1.0 + apr / 100.0, 1.0 / 12.0) - 1.0


# ---------------------------------------------------------------------------
# H4 / H5 projection
# ---------------------------------------------------------------------------

def _simulate(cols: dict, months: int, emit: np.ndarray) -> tuple[np.ndarray, dict]:
    """Month loop over all households of a batch at once (one numpy step per
    month). Same operations, in the same order, as the monthly model.
    ``cols``: name -> float64 array. Returns (household index per output row,
    balance name -> float64 array), rows ordered by month then household."""
    n = len(cols["checking"])
    b = {c: cols[c].copy() for c in BALANCES}
    fl = {c: cols[c] for c in FLOWS}
    factor = {c: 1.0 + monthly_rate(cols[r]) for c, r in {**_ASSET_RATE, **_DEBT_RATE}.items()}
    out = {c: [] for c in BALANCES}
    steps = []

    def record(t):
        steps.append(t)
        for c in BALANCES:
            out[c].append(b[c].copy())

    if emit[0]:
        record(0)
    for t in range(1, months + 1):
        # contributions before growth
        b["checking"] = b["checking"] + fl["contrib_checking"]
        b["savings_hysa"] = b["savings_hysa"] + fl["contrib_hysa"]
        b["retirement_invest"] = b["retirement_invest"] + fl["contrib_retirement"]
        # auto-move from checking, never more than what checking holds
        move = np.minimum(fl["move_checking_to_invest"], np.maximum(0.0, b["checking"]))
        b["checking"] = b["checking"] - move
        b["retirement_invest"] = b["retirement_invest"] + move
        # growth (checking earns nothing); cars never below zero
        for c in _ASSET_RATE:
            b[c] = b[c] * factor[c]
        b["cars_value"] = np.maximum(0.0, b["cars_value"])
        # debts accrue, then payments; nothing paid on a balance <= 0 or a payment <= 0
        for c in DEBTS:
            acc = b[c] * factor[c]
            p = fl[_DEBT_PAY[c]]
            b[c] = np.where((acc <= 0.0) | (p <= 0.0), acc, np.maximum(0.0, acc - p))
        if emit[t]:
            record(t)
    t_col = np.repeat(np.asarray(steps, dtype=np.int32), n)
    idx = np.tile(np.arange(n), len(steps))
    return t_col, idx, {c: (np.concatenate(out[c]) if steps else np.empty(0)) for c in BALANCES}


def project_net_worth(h: DataFrame, months: int = 600, emit: Sequence[int] | None = None,
                      start_month: str | None = None, keys: Sequence[str] = ("account_id",),
                      max_rows_per_batch: int = 1_000_000) -> DataFrame:
    """H4/H5: balances for months ``emit`` (default all of 0..months) of every
    household, rounded to cents, with totals and a ``yyyy-MM`` label counted
    from ``start_month`` (default: the current month).

    Runs as ``mapInArrow``: Arrow columns in, numpy month loop, Arrow record
    batches out (key columns carried with ``take``), no pandas in between."""
    import pyarrow as pa

    keys = list(keys)
    h = with_defaults(h).select(*keys, *BALANCES, *FLOWS, *RATE_DEFAULTS)
    flags = np.zeros(months + 1, dtype=bool)
    flags[list(range(months + 1)) if emit is None else [t for t in emit if 0 <= t <= months]] = True
    key_types = dict(h.dtypes)
    schema = ", ".join([f"{k} {key_types[k]}" for k in keys] + ["t int"]
                       + [f"{c} double" for c in BALANCES])
    # households per numpy step: as many as fit ~max_rows_per_batch emitted
    # rows, so short outputs (7 horizons) use whole Arrow batches and full
    # monthly series stay within a bounded batch size
    chunk = max(64, max_rows_per_batch // max(1, int(flags.sum())))
    numeric = BALANCES + FLOWS + list(RATE_DEFAULTS)

    def run(batches):
        for rb in batches:
            for i in range(0, rb.num_rows, chunk):
                part = rb.slice(i, chunk)
                cols = {c: part.column(c).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                        for c in numeric}
                t_col, idx, bal = _simulate(cols, months, flags)
                take = pa.array(idx)
                arrays = ([part.column(k).take(take) for k in keys] + [pa.array(t_col)]
                          + [pa.array(bal[c]) for c in BALANCES])
                yield pa.RecordBatch.from_arrays(arrays, names=keys + ["t"] + BALANCES)

    # The simulation multiplies work by the horizon while AQE sizes partitions
    # by input bytes, and households are narrow rows: spread them by account
    # over the cluster's cores (an explicit count, which AQE keeps) so every
    # core simulates a share. The shuffle moves the narrow input only.
    par = h.sparkSession.sparkContext.defaultParallelism
    h = h.repartition(par, keys[0])
    raw = h.mapInArrow(run, schema)
    start = (F.to_date(F.lit(start_month + "-01")) if start_month
             else F.trunc(F.current_date(), "MM"))
    return raw.select(
        *keys, "t",
        F.date_format(F.add_months(start, F.col("t")), "yyyy-MM").alias("month"),
        round_cents(_sum_cols(ASSETS)).alias("assets_total"),
        round_cents(_sum_cols(DEBTS)).alias("liabilities_total"),
        round_cents(_sum_cols(ASSETS) - _sum_cols(DEBTS)).alias("net_worth"),
        *[round_cents(c).alias(c) for c in BALANCES])


# ---------------------------------------------------------------------------
# H6 / H7
# ---------------------------------------------------------------------------

def horizons(h: DataFrame, start_month: str | None = None,
             keys: Sequence[str] = ("account_id",)) -> DataFrame:
    """H6: one projection to 600 months, filtered to the 7 horizons; change
    and change % against the unrounded current net worth (0 % if it is 0).
    The current net worth rides along the projection as a carried column, so
    the households are read once."""
    keys = list(keys)
    hh = net_worth(with_defaults(h)).withColumnRenamed("net_worth", "current_net_worth") \
        .drop("assets_total", "liabilities_total")
    hz = F.create_map(*[x for k, m in HORIZONS.items() for x in (F.lit(m), F.lit(k))])
    p = project_net_worth(hh, max(HORIZONS.values()), list(HORIZONS.values()), start_month,
                          keys + ["current_net_worth"])
    return p.select(*keys, hz[F.col("t")].alias("horizon"), F.col("t").cast("long").alias("months"),
                    "net_worth", "current_net_worth",
                    (F.col("net_worth") - F.col("current_net_worth")).alias("net_worth_change"),
                    F.when(F.col("current_net_worth") != 0,
                           (F.col("net_worth") - F.col("current_net_worth"))
                           / F.abs(F.col("current_net_worth")) * 100).otherwise(0.0)
                     .alias("net_worth_change_pct"),
                    "assets_total", "liabilities_total", *BALANCES)


def flow_summary(h: DataFrame) -> DataFrame:
    """H7: monthly contributions (without the auto-move), debt payments, net;
    plus the display total that does include the auto-move."""
    h = with_defaults(h)
    contrib = _sum_cols(CONTRIBUTIONS)
    pays = _sum_cols(PAYMENTS)
    return h.select("account_id",
                    contrib.alias("total_contributions_monthly"),
                    pays.alias("total_debt_payments_monthly"),
                    (contrib - pays).alias("net_monthly_cash_flow"),
                    (contrib + F.col("move_checking_to_invest")).alias("display_contributions_monthly"))


# ---------------------------------------------------------------------------
# H8-H10
# ---------------------------------------------------------------------------

def optimized_scenarios(h: DataFrame, savings: DataFrame) -> DataFrame:
    """Both scenarios as one table: ``optimized`` adds the account's monthly
    lever savings (missing -> 0) to the retirement contribution."""
    h = with_defaults(h).join(savings.select("account_id", "monthly_savings"), "account_id", "left") \
                        .withColumn("monthly_savings", F.coalesce("monthly_savings", F.lit(0.0)))
    orig = h.withColumn("scenario", F.lit("original"))
    opt = (h.withColumn("scenario", F.lit("optimized"))
            .withColumn("contrib_retirement", F.col("contrib_retirement") + F.col("monthly_savings")))
    return orig.unionByName(opt)


def optimized_projection(h: DataFrame, savings: DataFrame, start_month: str | None = None) -> DataFrame:
    """H8: horizons of both scenarios side by side; improvement and % of
    |original| (0 if the original is 0). Savings and current net worth are
    carried through the projection, so the scenario table is built once."""
    both = net_worth(optimized_scenarios(h, savings)).withColumnRenamed("net_worth", "current_net_worth")
    p = project_net_worth(both, max(HORIZONS.values()), list(HORIZONS.values()), start_month,
                          keys=("account_id", "scenario", "monthly_savings", "current_net_worth"))
    wide = (p.groupBy("account_id", "t").agg(
        F.max(F.when(F.col("scenario") == "original", F.col("net_worth"))).alias("original_net_worth"),
        F.max(F.when(F.col("scenario") == "optimized", F.col("net_worth"))).alias("optimized_net_worth"),
        F.max("monthly_savings").alias("monthly_savings"),
        F.max("current_net_worth").alias("current_net_worth")))
    hz = F.create_map(*[x for k, m in HORIZONS.items() for x in (F.lit(m), F.lit(k))])
    imp = F.col("optimized_net_worth") - F.col("original_net_worth")
    return wide.select("account_id", hz[F.col("t")].alias("horizon"), F.col("t").cast("long").alias("months"),
                       "monthly_savings", "original_net_worth", "optimized_net_worth",
                       (F.col("original_net_worth") - F.col("current_net_worth")).alias("original_change"),
                       (F.col("optimized_net_worth") - F.col("current_net_worth")).alias("optimized_change"),
                       imp.alias("improvement"),
                       F.when(F.col("original_net_worth") != 0,
                              imp / F.abs(F.col("original_net_worth")) * 100).otherwise(0.0)
                        .alias("improvement_pct"))


def growth_stats(h: DataFrame, savings: DataFrame, months: int, start_month: str | None = None) -> DataFrame:
    """H9: growth over the time frame (last - first rounded net worth), % of
    the first (signed divisor; 0 when it is 0), optimised growth and the
    gain of the optimised scenario over the original at the end."""
    both = optimized_scenarios(h, savings)
    p = project_net_worth(both, months, [0, months], start_month, keys=("account_id", "scenario"))
    nw = lambda sc, t: F.max(F.when((F.col("scenario") == sc) & (F.col("t") == t),
                                    F.col("net_worth")))
    g = p.groupBy("account_id").agg(
        nw("original", 0).alias("current_net_worth"), nw("original", months).alias("projected_net_worth"),
        nw("optimized", 0).alias("optimized_current"), nw("optimized", months).alias("optimized_projected"))
    growth = F.col("projected_net_worth") - F.col("current_net_worth")
    return g.select("account_id", F.lit(months).cast("long").alias("months"),
                    "current_net_worth", "projected_net_worth", growth.alias("total_growth"),
                    F.when(F.col("current_net_worth") != 0, growth / F.col("current_net_worth") * 100)
                     .otherwise(0.0).alias("growth_pct"),
                    (F.col("optimized_projected") - F.col("optimized_current")).alias("optimized_growth"),
                    (F.col("optimized_projected") - F.col("projected_net_worth")).alias("savings_improvement"))


def downsample_step(months: int) -> int:
    """> 120 months -> every ceil(T/60)-th point, > 24 -> ceil(T/30), else all."""
    if months > 120:
        return -(-months // 60)
    if months > 24:
        return -(-months // 30)
    return 1


def downsample(proj: DataFrame, months: int) -> DataFrame:
    """Keep every step-th month of a projection; label like 'Jan 2024'."""
    step = downsample_step(months)
    label = F.date_format(F.to_date(F.concat(F.col("month"), F.lit("-01"))), "MMM yyyy")
    return (proj.filter((F.col("t") <= months) & (F.col("t") % step == 0))
                .withColumn("label", label))


__all__ = ["with_defaults", "net_worth", "monthly_rate", "project_net_worth", "horizons",
           "flow_summary", "optimized_scenarios", "optimized_projection", "growth_stats",
           "downsample", "downsample_step", "Window"]
