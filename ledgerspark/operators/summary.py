"""Account summary (D1-D14): one ``groupBy(account_id)`` per report.

All aggregates here are algebraic (count/sum/min/max, percentiles over a
pre-aggregated table) so Spark combines them map-side before the shuffle; a
hot account costs one partial row per map task, not a third of the data in
one reducer. Windows only run over already-aggregated periods/categories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import UNCATEGORIZED, drop_incomplete, is_income
from ..functions.numeric import round_to
from .periods import money, safe_div
from .selection import at_ranks, value_counts

CONFIDENCE_RANGES = 1000   # of the interval from 0 to 1, in which the median is looked for
CANONICAL_COLUMNS = ["txn_date", "description", "amount", "category", "confidence"]


def account_totals(txn: DataFrame) -> DataFrame:
    """Rows (NULL amounts counted), net, income, |expenses|, mean, max, min."""
    a = F.col("amount")
    return txn.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        money(F.coalesce(F.sum(a), F.lit(0))).alias("total_amount"),
        money(F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0))).alias("total_income"),
        money(F.abs(F.coalesce(F.sum(F.when(a < 0, a)), F.lit(0)))).alias("total_expenses"),
        safe_div(money(F.sum(a)), F.count(a).cast("double")).alias("average_transaction"),
        money(F.max(a)).alias("largest_transaction"),
        money(F.min(a)).alias("smallest_transaction"))


def category_breakdown(txn: DataFrame) -> DataFrame:
    """Per category (Income included): signed sum, rows, mean."""
    a = F.col("amount")
    return txn.groupBy("account_id", "category").agg(
        money(F.coalesce(F.sum(a), F.lit(0))).alias("total_amount"),
        F.count(F.lit(1)).alias("transaction_count"),
        safe_div(money(F.sum(a)), F.count(a).cast("double")).alias("average_amount"))


def date_range(txn: DataFrame) -> DataFrame:
    """D3: first and last usable date, whole days between."""
    return (txn.filter(F.col("txn_date").isNotNull()).groupBy("account_id")
            .agg(F.min("txn_date").alias("start_date"), F.max("txn_date").alias("end_date"))
            .withColumn("days_covered", F.datediff("end_date", "start_date").cast("long")))


def count_by_month(txn: DataFrame) -> DataFrame:
    """Rows per yyyy-MM."""
    return (txn.filter(F.col("txn_date").isNotNull())
            .groupBy("account_id", F.date_format("txn_date", "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("transactions")))


def count_by_weekday(txn: DataFrame) -> DataFrame:
    """Rows per English day name."""
    return (txn.filter(F.col("txn_date").isNotNull())
            .groupBy("account_id", F.date_format("txn_date", "EEEE").alias("weekday"))
            .agg(F.count(F.lit(1)).alias("transactions")))


# ---------------------------------------------------------------------------
# D6 / D7 period sums and trend
# ---------------------------------------------------------------------------

# A grain is reported only when the account has more usable
# rows than this (daily always).
GRAIN_MIN_ROWS = {"daily": 0, "weekly": 7, "monthly": 30}


def _period_label(grain: str):
    d = F.col("txn_date")
    if grain == "daily":
        return F.date_format(d, "yyyy-MM-dd")
    if grain == "weekly":
        mon = F.date_trunc("week", d).cast("date")
        return F.concat_ws("/", F.date_format(mon, "yyyy-MM-dd"),
                           F.date_format(F.date_add(mon, 6), "yyyy-MM-dd"))
    return F.date_format(d, "yyyy-MM")


def period_sums(txn: DataFrame) -> DataFrame:
    """(account_id, grain, kind, period, amount) for the periods that occur.

    Income and spending are separate series (a period appears in a series only
    if the series has rows there). Weekly needs > 7 usable rows, monthly > 30.
    One scan: rows are summed up by day, only the day rows get three period labels, and
    the row-count gate is read off the aggregated daily rows."""
    t = drop_incomplete(txn)
    labels = F.array(*[F.struct(F.lit(g).alias("grain"), _period_label(g).alias("period"))
                       for g in GRAIN_MIN_ROWS])
    kind = F.when(is_income(), F.lit("income")).otherwise(F.lit("spending"))
    days = (t.groupBy("account_id", kind.alias("kind"), "txn_date")
             .agg(F.sum("amount").alias("_day"), F.count(F.lit(1)).alias("_rows_day")))
    g = (days.select("account_id", "kind", "_day", "_rows_day", F.explode(labels).alias("p"))
             .groupBy("account_id", F.col("p.grain").alias("grain"), "kind", F.col("p.period").alias("period"))
             .agg(F.sum("_day").alias("_sum"), F.sum("_rows_day").alias("_n")))
    rows = F.sum(F.when(F.col("grain") == "daily", F.col("_n"))).over(Window.partitionBy("account_id"))
    gate = F.col("grain").isin("daily") | ((F.col("grain") == "weekly") & (F.col("_rows") > GRAIN_MIN_ROWS["weekly"])) \
        | ((F.col("grain") == "monthly") & (F.col("_rows") > GRAIN_MIN_ROWS["monthly"]))
    return (g.withColumn("_rows", rows).filter(gate)
             .select("account_id", "grain", "kind", "period", money("_sum").alias("amount")))


def trend(sums: DataFrame) -> DataFrame:
    """OLS slope of each series against 0,1,2,... over its present periods
    (gaps collapse), on the coarsest grain the account has; < 2 points -> 0.
    Slopes are rounded to 4 decimals; direction follows the rounded slope."""
    rank = F.when(F.col("grain") == "monthly", 3).when(F.col("grain") == "weekly", 2).otherwise(1)
    # coarsest grain per account: a window over the aggregated period rows
    # (bounded per account) instead of an aggregate joined back, so the sums
    # are computed once
    s = (sums.withColumn("_g", F.max(rank).over(Window.partitionBy("account_id")))
             .filter(rank == F.col("_g")))
    w = Window.partitionBy("account_id", "kind").orderBy("period")
    s = s.withColumn("_x", (F.row_number().over(w) - 1).cast("double"))
    slopes = s.groupBy("account_id", "grain").agg(
        round_to(F.coalesce(F.regr_slope(F.when(F.col("kind") == "income", F.col("amount")),
                                         F.col("_x")), F.lit(0.0)), 4).alias("income_trend"),
        round_to(F.coalesce(F.regr_slope(F.when(F.col("kind") == "spending", F.col("amount")),
                                         F.col("_x")), F.lit(0.0)), 4).alias("spending_trend"))

    def direction(c):
        return (F.when(F.col(c) > 0, "increasing").when(F.col(c) < 0, "decreasing")
                .otherwise("stable"))
    return slopes.select("account_id", "grain", "income_trend", "spending_trend",
                         direction("income_trend").alias("income_trend_direction"),
                         direction("spending_trend").alias("spending_trend_direction"))


# ---------------------------------------------------------------------------
# D8-D12 category analysis
# ---------------------------------------------------------------------------

def income_vs_spending(txn: DataFrame) -> DataFrame:
    inc = is_income()
    n = F.count(F.lit(1)).cast("double")
    return txn.groupBy("account_id").agg(
        F.count(F.when(inc, 1)).alias("income_transactions"),
        F.count(F.when(~inc, 1)).alias("spending_transactions"),
        (F.count(F.when(inc, 1)) / n * 100).alias("income_percentage"),
        (F.count(F.when(~inc, 1)) / n * 100).alias("spending_percentage"))


def top_categories_by_count(txn: DataFrame, n: int = 10) -> DataFrame:
    """Spending categories by rows (ties: category asc)."""
    g = txn.filter(~is_income()).groupBy("account_id", "category").agg(
        F.count(F.lit(1)).alias("transactions"))
    w = Window.partitionBy("account_id").orderBy(F.desc("transactions"), F.asc("category"))
    return (g.withColumn("rank", F.row_number().over(w).cast("long"))
             .filter(F.col("rank") <= n))


def category_distribution(txn: DataFrame) -> DataFrame:
    """Percent of rows per category (2 decimals) and distinct categories."""
    g = txn.groupBy("account_id", "category").agg(F.count(F.lit(1)).alias("transactions"))
    acct = Window.partitionBy("account_id")
    return g.select(
        "account_id", "category", "transactions",
        round_to(F.col("transactions") / F.sum("transactions").over(acct) * 100, 2).alias("percentage"),
        F.count(F.lit(1)).over(acct).alias("unique_categories"))


def confidence_stats(txn: DataFrame) -> DataFrame:
    """Confidence over spending rows; no spending rows -> zeros,
    one row -> NULL standard deviation. Rounded to 6 decimals. The median is an exact
    selection on the counted values."""
    conf = F.when(~is_income(), F.col("confidence"))
    rows = txn.select("account_id", conf.alias("confidence"))
    counts = value_counts(rows, ["account_id"], "confidence", lambda c: F.floor(c * CONFIDENCE_RANGES))
    middle = (F.col("tot") - 1) / 2
    mid = at_ranks(counts, ["account_id"], "confidence", {"lo": F.floor(middle), "hi": F.ceil(middle)})
    n = F.col("n")

    def z(c):
        return round_to(F.when(n == 0, F.lit(0.0)).otherwise(c), 6)
    stats = rows.groupBy("account_id").agg(
        F.count("confidence").alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("min"),
        F.max("confidence").alias("max"), F.stddev_samp("confidence").alias("std"))
    mid = mid.withColumnRenamed("account_id", "_account")
    return stats.join(mid, F.col("account_id").eqNullSafe(F.col("_account")), "left").select(
        "account_id", z(F.col("mean")).alias("mean_confidence"),
        z(F.col("lo") + (F.col("hi") - F.col("lo")) * 0.5).alias("median_confidence"),
        z(F.col("min")).alias("min_confidence"), z(F.col("max")).alias("max_confidence"),
        z(F.col("std")).alias("std_confidence"))


def uncategorized_rate(txn: DataFrame) -> DataFrame:
    """Uncategorized spending rows, count and percent of spending rows."""
    spend = ~is_income()
    unc = spend & (F.col("category") == UNCATEGORIZED)
    ns = F.count(F.when(spend, 1))
    return txn.groupBy("account_id").agg(
        F.count(F.when(unc, 1)).alias("uncategorized_count"),
        F.when(ns > 0, F.count(F.when(unc, 1)) / ns * 100).otherwise(F.lit(0.0))
         .alias("uncategorized_percentage"))


# ---------------------------------------------------------------------------
# D13 / D14 data quality and profile
# ---------------------------------------------------------------------------

def data_quality(txn: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULLs per column, fully duplicate rows beyond the first (NULLs
    compare equal), number of all-NULL columns."""
    cols = columns or [c for c in txn.columns if c != "account_id"]
    nulls = txn.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("_n"),
        *[(F.count(F.lit(1)) - F.count(c)).alias(f"null_{c}") for c in cols])
    dups = (txn.groupBy("account_id", *cols).agg(F.count(F.lit(1)).alias("_k"))
               .groupBy("account_id").agg(F.sum(F.col("_k") - 1).alias("duplicate_rows")))
    all_null = sum((F.col(f"null_{c}") == F.col("_n")).cast("long") for c in cols)
    types = ",".join(f"{c}:{t}" for c, t in txn.dtypes if c in cols)
    return (nulls.join(dups, "account_id")
            .withColumn("columns_with_all_nulls", all_null)
            .withColumn("column_types", F.lit(types)).drop("_n"))


def file_profile(txn: DataFrame, n_sample: int = 5) -> DataFrame:
    """Rows and columns per account plus the first ``n_sample`` rows in
    (date, description, amount) order. ``row_number() <= n`` is planned as a
    partial group limit before the shuffle, so a hot account ships at most
    ``n`` rows per map task."""
    w = Window.partitionBy("account_id").orderBy(
        F.asc_nulls_last("txn_date"), F.asc_nulls_last("description"),
        F.asc_nulls_last("amount"), F.asc_nulls_last("category"), F.asc_nulls_last("confidence"))
    sample = txn.withColumn("sample_rank", F.row_number().over(w)).filter(
        F.col("sample_rank") <= n_sample)
    sizes = txn.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return (sample.join(sizes, "account_id")
            .select("account_id", F.col("sample_rank").cast("long").alias("sample_rank"),
                    "txn_date", "description", money("amount").alias("amount"), "category",
                    "n_rows", F.lit(len(txn.columns)).cast("long").alias("n_columns"),
                    F.lit(",".join(txn.columns)).alias("column_names")))
