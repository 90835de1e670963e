"""Period reports, dense daily series and period-over-period deltas.

Every "whole file" quantity of the reference (latest date, totals, top-N) is
per ``account_id`` here. One account may hold a third of all rows, so the ledger
is first summed to days (map-side combined, dealt by account, day and category);
the latest date, the look-back filter and every total come from these day rows,
of which an account has at most calendar days x categories. Raw rows are never
joined or windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import drop_incomplete, is_income

# ---------------------------------------------------------------------------
# Look-back offsets in days. They differ per report and are part
# of the contract: the series report keeps N+1 calendar days, the category
# report N days, the insight/lever reports 30 days and the prior window 29.
# ---------------------------------------------------------------------------
SERIES_DAYS = {"14d": 14, "30d": 30, "90d": 90, "1y": 365}
CATEGORY_DAYS = {"14d": 13, "30d": 29, "90d": 89, "1y": 364}
CURRENT_DAYS = 29          # current period = [max - 29, max]
PRIOR_DAYS = 29            # prior period = [max - 58, max - 29)
SAVINGS_DAYS = 90


def money(c: Column | str) -> Column:
    """DECIMAL money column -> DOUBLE for output."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double")


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI mode would raise)."""
    return F.when(b != 0, a / b)


def _resolve(period: str | int, table: dict) -> int:
    return table[period] if isinstance(period, str) else int(period)


# ---------------------------------------------------------------------------
# E1
# ---------------------------------------------------------------------------

def period_bounds(txn: DataFrame, days: int) -> DataFrame:
    """(account_id, period_start, period_end): end = latest usable date."""
    return (txn.groupBy("account_id").agg(F.max("txn_date").alias("period_end"))
               .withColumn("period_start", F.date_sub("period_end", days)))


def window_last(txn: DataFrame, days: int) -> DataFrame:
    """Raw rows from (account's latest date - days) on, with period_start/end, for
    operators that work on single transactions. Rows without date or amount are
    dropped first, as every period report of the reference does."""
    t = drop_incomplete(txn)
    return t.join(period_bounds(t, days), "account_id").filter(F.col("txn_date") >= F.col("period_start"))


def day_rows(txn: DataFrame, *keys: str) -> DataFrame:
    """(account_id, txn_date, income, *keys) with sums, counts and extremes of the
    complete rows: ``amount``, ``inflow`` (positive part), ``outflow`` (negative
    part), ``n``, ``low``, ``high``."""
    a = F.col("amount")
    return (drop_incomplete(txn)
            .groupBy("account_id", "txn_date", is_income().alias("income"), *keys)
            .agg(F.sum(a).alias("amount"), F.sum(F.when(a > 0, a)).alias("inflow"),
                 F.sum(F.when(a < 0, a)).alias("outflow"), F.count(F.lit(1)).alias("n"),
                 F.min(a).alias("low"), F.max(a).alias("high")))


def window_days(txn: DataFrame, days: int, *keys: str) -> DataFrame:
    """:func:`day_rows` from (account's latest date - days) on, with period_start/end.
    The window holds one account's day rows, so ``keys`` must have few values per
    account (categories); see :func:`_recent_descriptions` for others."""
    end = F.max("txn_date").over(Window.partitionBy("account_id"))
    return (day_rows(txn, *keys).withColumn("period_end", end)
            .withColumn("period_start", F.date_sub("period_end", days))
            .filter(F.col("txn_date") >= F.col("period_start")))


def _sum_where(flag: Column, value: str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(flag, F.col(value))), F.lit(0))


# ---------------------------------------------------------------------------
# E2 / E3 cumulative daily series
# ---------------------------------------------------------------------------

def daily_series(txn: DataFrame, period: str | int = "30d") -> DataFrame:
    days = _resolve(period, SERIES_DAYS)
    t = window_days(txn, days)
    inc = F.col("income")
    daily = t.groupBy("account_id", "txn_date").agg(
        F.sum(F.when(inc, F.col("amount"))).alias("_inc"),
        F.sum(F.when(~inc, F.col("amount"))).alias("_spd"))
    cal = (t.select("account_id", "period_start", "period_end").distinct()
           .select("account_id",
                   F.explode(F.sequence("period_start", "period_end")).alias("txn_date")))
    w = (Window.partitionBy("account_id").orderBy("txn_date")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = cal.join(daily, ["account_id", "txn_date"], "left")
    inc0 = F.coalesce("_inc", F.lit(0).cast("decimal(18,2)"))
    spd0 = F.coalesce("_spd", F.lit(0).cast("decimal(18,2)"))
    return s.select(
        "account_id", F.col("txn_date").alias("date"),
        money(inc0).alias("daily_income"),
        money(F.sum(inc0).over(w)).alias("cumulative_income"),
        money(F.abs(spd0)).alias("daily_spending"),
        money(F.abs(F.sum(spd0).over(w))).alias("cumulative_spending"))


def series_summary(txn: DataFrame, period: str | int = "30d") -> DataFrame:
    days = _resolve(period, SERIES_DAYS)
    t = window_days(txn, days)
    inc = F.col("income")
    ti, ts = _sum_where(inc), F.abs(_sum_where(~inc))
    return t.groupBy("account_id", "period_start", "period_end").agg(
        money(ti).alias("total_income"),
        money(ts).alias("total_spending"),
        money(ti - ts).alias("net_amount"),
        _sum_where(inc, "n").alias("income_transactions"),
        _sum_where(~inc, "n").alias("spending_transactions"),
    ).select("account_id", F.col("period_start").alias("start_date"),
             F.col("period_end").alias("end_date"),
             F.lit(days + 1).cast("long").alias("data_points"),
             "total_income", "total_spending", "net_amount",
             "income_transactions", "spending_transactions")


# ---------------------------------------------------------------------------
# E4-E6 categories by period
# ---------------------------------------------------------------------------

def categories_by_period(txn: DataFrame, period: str | int = "30d") -> DataFrame:
    """Per spending category over the period. Amounts are negative, so
    ``min_amount`` is |most negative| -- the larger absolute value."""
    days = _resolve(period, CATEGORY_DAYS)
    t = window_days(txn, days, "category").filter(~F.col("income"))
    g = t.groupBy("account_id", "category").agg(
        F.sum("amount").alias("_sum"), F.sum("n").alias("transaction_count"),
        F.min("low").alias("_min"), F.max("high").alias("_max"))
    total = F.sum("_sum").over(Window.partitionBy("account_id"))
    return g.select(
        "account_id", "category",
        money(F.abs("_sum")).alias("total_amount"),
        "transaction_count",
        F.abs(money("_sum") / F.col("transaction_count")).alias("average_amount"),
        money(F.abs("_min")).alias("min_amount"),
        money(F.abs("_max")).alias("max_amount"),
        (safe_div(money(F.abs("_sum")), money(F.abs(total))) * 100).alias("percentage_of_spending"))


def top_categories(cat: DataFrame, n: int = 10) -> DataFrame:
    """Rank by total desc (ties: category asc); keep the top ``n``."""
    w = Window.partitionBy("account_id").orderBy(F.desc("total_amount"), F.asc("category"))
    return cat.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def category_summary(txn: DataFrame, period: str | int = "30d") -> DataFrame:
    days = _resolve(period, CATEGORY_DAYS)
    t = window_days(txn, days, "category")
    inc = F.col("income")
    ti, ts = _sum_where(inc), F.abs(_sum_where(~inc))
    return t.groupBy("account_id", "period_start", "period_end").agg(
        money(ti).alias("total_income"), money(ts).alias("total_spending"),
        money(ti - ts).alias("net_amount"),
        _sum_where(inc, "n").alias("income_transactions"),
        _sum_where(~inc, "n").alias("spending_transactions"),
        F.count_distinct(F.when(~inc, F.col("category"))).alias("unique_categories"),
    ).select("account_id", F.col("period_start").alias("start_date"),
             F.col("period_end").alias("end_date"),
             F.lit(days + 1).cast("long").alias("days_covered"),
             "total_income", "total_spending", "net_amount", "income_transactions",
             "spending_transactions", "unique_categories")


# ---------------------------------------------------------------------------
# E7-E9 current 30 days vs prior window
# ---------------------------------------------------------------------------

def _current_prior(txn: DataFrame) -> DataFrame:
    """Day rows by category of [max-58, max] with flags ``_cur`` (>= max-29) and ``_pri``."""
    t = window_days(txn, CURRENT_DAYS + PRIOR_DAYS, "category")
    cur_start = F.date_sub("period_end", CURRENT_DAYS)
    return (t.withColumn("_cur", F.col("txn_date") >= cur_start)
             .withColumn("_pri", F.col("txn_date") < cur_start))


def current_vs_prior(txn: DataFrame, windowed: DataFrame | None = None) -> DataFrame:
    """E7 (``windowed``: a precomputed :func:`_current_prior` to share)."""
    t = windowed if windowed is not None else _current_prior(txn)
    inc = F.col("income")

    def s(flag, income):
        return _sum_where(F.col(flag) & (inc if income else ~inc))

    ci, ce = s("_cur", True), F.abs(s("_cur", False))
    pi, pe = s("_pri", True), F.abs(s("_pri", False))
    return t.groupBy("account_id").agg(
        money(ci).alias("current_income"), money(ce).alias("current_expenses"),
        money(ci - ce).alias("current_net"),
        money(pi).alias("prior_income"), money(pe).alias("prior_expenses"),
        money(pi - pe).alias("prior_net"),
        money((ci - ce) - (pi - pe)).alias("net_change"))


def category_deltas(txn: DataFrame, windowed: DataFrame | None = None) -> DataFrame:
    """Spending categories present in the current period; prior missing -> 0."""
    t = (windowed if windowed is not None else _current_prior(txn)).filter(~F.col("income"))
    cur, pri = F.abs(_sum_where(F.col("_cur"))), F.abs(_sum_where(F.col("_pri")))
    return (t.groupBy("account_id", "category")
             .agg(money(cur).alias("current_amount"), money(pri).alias("prior_amount"),
                  money(cur - pri).alias("delta_amount"),
                  F.count(F.when(F.col("_cur"), 1)).alias("_n"))
             .filter(F.col("_n") > 0).drop("_n"))


def _recent_descriptions(txn: DataFrame, days: int) -> DataFrame:
    """Day rows by description from (account's latest date - days) on. An account may
    have any number of descriptions, so the latest date is an aggregate of the day rows
    that is joined back, not a window over them."""
    d = day_rows(txn, "description")
    return (d.join(period_bounds(d, days), "account_id")
             .filter((F.col("txn_date") >= F.col("period_start")) & F.col("description").isNotNull()))


def top_merchants(txn: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent spending descriptions of the current period. The
    amount sums every current row with that description, income rows included."""
    g = _recent_descriptions(txn, CURRENT_DAYS).groupBy("account_id", "description").agg(
        _sum_where(~F.col("income"), "n").alias("count"),
        money(F.abs(F.sum("amount"))).alias("total_amount"))
    w = Window.partitionBy("account_id").orderBy(F.desc("count"), F.asc("description"))
    return (g.filter(F.col("count") > 0)
             .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
             .withColumnRenamed("description", "merchant"))


# ---------------------------------------------------------------------------
# E13-E15 derived display metrics
# ---------------------------------------------------------------------------

def largest_spending_day(series: DataFrame) -> DataFrame:
    """Day with the largest daily spending (earliest on ties); accounts whose
    period has no spending give no row."""
    best = F.max(F.struct(F.col("daily_spending").alias("s"),
                          (-F.unix_date("date")).alias("d")))
    return (series.filter(F.col("daily_spending") > 0).groupBy("account_id")
            .agg(best.alias("_b"))
            .select("account_id", F.date_from_unix_date(-F.col("_b.d")).alias("date"),
                    F.col("_b.s").alias("amount")))


def category_spend_lookup(txn: DataFrame, category: str, period: str | int = "30d",
                          n: int = 10) -> DataFrame:
    """Period total of one category if it is among the top ``n``, else 0."""
    days = _resolve(period, CATEGORY_DAYS)
    top = top_categories(categories_by_period(txn, days), n)
    hit = (top.filter(F.col("category") == category)
              .select("account_id", F.col("total_amount").alias("_t")))
    accounts = drop_incomplete(txn).select("account_id").distinct()
    return (accounts.join(hit, "account_id", "left")
            .select("account_id", F.lit(category).alias("category"),
                    F.coalesce("_t", F.lit(0.0)).alias("amount")))


def share_of_total(cat: DataFrame, value: str = "total_amount") -> DataFrame:
    """Percent of the displayed total per account (rows already bounded)."""
    # the total is summed exactly (values are cents) so the share does not
    # depend on the order rows arrive in
    total = F.sum(F.col(value).cast("decimal(28,2)")).over(Window.partitionBy("account_id"))
    return cat.withColumn("share_pct", safe_div(F.col(value), total.cast("double")) * 100)
