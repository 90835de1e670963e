"""Recurring-charge (subscription) detection, F1-F16.

Group = (account_id, normalised merchant). A single group may be huge (one
merchant can hold a third of an account's rows), so no step windows or
collects the raw rows of a group:

* row-level aggregates (count, sums, stddev) are partial aggregates;
* order-dependent features (day gaps, day-of-month mode, the 30-day
  autocorrelation) run on the *day table* -- one row per (group, date) --
  whose size per group is bounded by the calendar span, not by row count;
* quantiles run on a (group, amount) -> count table by exact selection
  (``selection``): the ranges of amounts that hold the interpolation ranks are
  found by cumulative counts, and only these are put in order.

Model training uses ``pyspark.ml`` (logistic regression); scoring is a
``PipelineModel.transform``.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import normalize_merchant
from ..functions.numeric import round_cents, round_to
from ..session import checkpoint_dir
from .selection import at_ranks, money_range, value_counts

# Feature column order of the saved model, seed merchants that
# label a group as a known subscription, autocorrelation lag.
FEATURE_COLS = ["n_occurrences", "coverage_months", "median_gap_days", "gap_cv",
                "day_of_month_mode", "dom_consistency", "amount_mean", "amount_cv",
                "amount_iqr_ratio", "autocorr_30d", "share_negative", "span_days"]
SEED_MERCHANTS = ["NETFLIX", "SPOTIFY", "ICLOUD", "CITY GYM"]
LAG_DAYS = 30
KEYS = ["account_id", "merchant"]
SCORE_RANGES = 4096        # of the interval from 0 to 1, in which scores are counted
SPLIT_BITS = 16            # the hold-out split counts rows in 2^16 hash ranges per label


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder once; every later pass reads it, none computes
    it again."""
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/ledgerspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def expense_projection(txn: DataFrame) -> DataFrame:
    """expense rows (amount <= 0; NULL amounts are not expenses) with date
    and description, plus the normalised merchant."""
    return (txn.filter(F.col("amount") <= 0)
               .dropna(subset=["txn_date", "description"])
               .select("account_id", "txn_date", "description", "amount",
                       normalize_merchant("description").alias("merchant")))


def merchant_features(exp: DataFrame, decimals: int = 6) -> DataFrame:
    """The 12 features per (account_id, merchant).

    ``exp`` is the output of :func:`expense_projection`; its four columns are written
    once, so each description is normalised once, not in every pass (and again for each
    condition on the merchant). Two partial aggregates of the rows feed everything:

    * day table (group, date) -> rows. One window pass over it (gap to the
      previous day, whether the day 30 days later has a hit, group first/last
      day) and one aggregate give rows, months, span, gap moments, the median
      gap, the day-of-month mode and the 30-day autocorrelation. Its size per
      group is the number of distinct days, bounded by the calendar span.
    * amount table (group, amount) -> rows. One aggregate gives the mean, exact
      decimal variance and share of negative rows, a selection the quartiles
      (linear interpolation).

    Ratio features are rounded to ``decimals``. ``gap_cv`` is NULL when there
    are exactly two rows (one gap: undefined sample deviation);
    ``finite_or_zero`` turns it into 0 for the model."""
    exp = written(exp.select(*KEYS, "txn_date", "amount"), "expenses")
    days = exp.groupBy(*KEYS, "txn_date").agg(F.count(F.lit(1)).alias("n_day"))
    ud = F.unix_date("txn_date")
    w = Window.partitionBy(*KEYS).orderBy(ud)
    whole = Window.partitionBy(*KEYS)
    prev = F.lag("txn_date").over(w)
    d = (days.withColumn("gap", F.datediff("txn_date", prev))
             .withColumn("new_month", prev.isNull() | (F.trunc(prev, "MM") != F.trunc("txn_date", "MM")))
             .withColumn("hit30", F.count(F.lit(1)).over(w.rangeBetween(LAG_DAYS, LAG_DAYS)))
             .withColumn("first", F.min("txn_date").over(whole))
             .withColumn("last", F.max("txn_date").over(whole))
             # rows on the same day of month; (group, dom) is a finer clustering
             # than the group's, so this window needs no new exchange
             .withColumn("dom", F.dayofmonth("txn_date"))
             .withColumn("dom_rows", F.sum("n_day").over(Window.partitionBy(*KEYS, "dom"))))

    x_part = F.col("txn_date") <= F.date_sub("last", LAG_DAYS)     # offsets 0..L-31
    y_part = F.col("txn_date") >= F.date_add("first", LAG_DAYS)    # offsets 30..L-1
    g = d.groupBy(*KEYS).agg(
        F.sum("n_day").alias("n"),
        F.count(F.lit(1)).alias("n_days"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum(F.col("gap").cast("long") * F.col("gap")).alias("sum_g2"),
        # days are ordered: distinct months = days opening a new month (no
        # distinct aggregate, so no Expand of the day rows)
        F.count(F.when(F.col("new_month"), 1)).alias("coverage_months"),
        F.array_sort(F.collect_list("gap")).alias("_pos_gaps"),
        F.max(F.struct("dom_rows", (-F.col("dom")).alias("neg_dom"))).alias("_mode"),
        F.count(F.when(x_part, 1)).alias("_sx"),
        F.count(F.when(y_part, 1)).alias("_sy"),
        F.count(F.when(x_part & (F.col("hit30") > 0), 1)).alias("_sxy"))

    # amount table: (group, amount) -> rows; moments are partial sums, the quartiles exact
    # selections by ranges of amounts
    amt = F.col("amount")
    av = value_counts(exp, KEYS, "amount", money_range)
    pos = {q: (F.col("tot") - 1) * q for q in (0.25, 0.75)}
    quartiles = at_ranks(av, KEYS, "amount", {f"_{end}{int(q * 100)}": cut(pos[q]) for q in pos
                                              for end, cut in (("lo", F.floor), ("hi", F.ceil))})
    amounts = av.groupBy(*KEYS).agg(
        F.sum("k").alias("_na"),
        F.sum(amt * F.col("k")).alias("_sa"),
        F.sum(amt * amt * F.col("k")).alias("_s2"),
        F.sum(F.when(amt < 0, F.col("k"))).alias("_neg")).join(quartiles, KEYS)

    def quartile(q):                      # linear interpolation between neighbours
        at = (F.col("_na") - 1) * (q / 100)
        lo, hi = (F.col(f"_{end}{q}").cast("double") for end in ("lo", "hi"))
        return lo + (hi - lo) * (at - F.floor(at))
    f = g.join(amounts, KEYS, "left").withColumn("span_days", F.datediff("last", "first"))

    n = F.col("n")
    ng = n - 1                                              # number of gaps

    # median of the gap multiset: (n - n_days) zero gaps, then the sorted
    # day-to-day gaps; linear interpolation like numpy
    zeros = n - F.col("n_days")
    pos = (ng - 1).cast("double") * 0.5

    def gap_at(i):
        return F.when(i < zeros, F.lit(0)).otherwise(
            F.element_at("_pos_gaps", (i - zeros + 1).cast("int")))
    lo, hi = F.floor(pos), F.ceil(pos)
    median_gap = (gap_at(lo) + (gap_at(hi) - gap_at(lo)) * (pos - lo)).cast("double")

    mean_gap = F.col("span_days") / ng
    # sample variance of the gaps, exact integer numerator
    var_num = ((ng.cast("decimal(38,0)") * F.col("sum_g2")) -
               (F.col("span_days").cast("decimal(38,0)") * F.col("span_days")))
    std_gap = F.sqrt(var_num.cast("double") / (ng * (ng - 1)).cast("double"))
    gap_cv = (F.when(n < 2, F.lit(1.0))
               .when(mean_gap == 0, F.lit(1.0))
               .when(ng < 2, F.lit(None).cast("double"))
               .otherwise(std_gap / mean_gap))

    mode_rows = F.col("_mode.dom_rows")
    mode_day = -F.col("_mode.neg_dom")                            # smallest day on ties

    na = F.coalesce(F.col("_na"), F.lit(0))
    amean = F.when(na > 0, F.col("_sa").cast("double") / na).otherwise(0.0)
    big = F.abs(amean) > 1e-9
    # sample variance from exact decimal moments: (N*S2 - S1^2) / (N(N-1))
    a_var = ((na.cast("decimal(20,0)") * F.col("_s2") - F.col("_sa") * F.col("_sa")).cast("double")
             / (na * (na - 1)).cast("double"))
    amount_cv = F.when((na > 1) & big, F.sqrt(a_var) / F.abs(amean)).otherwise(0.0)
    iqr = F.when((na >= 4) & big, (quartile(75) - quartile(25)) / F.abs(amean)).otherwise(0.0)

    # Pearson r of x[:-30] and x[30:] of the dense 0/1 daily series:
    # r = (N*Sxy - Sx*Sy) / sqrt((N*Sx - Sx^2)(N*Sy - Sy^2)), N = L - 30
    big_n = (F.col("span_days") + 1 - LAG_DAYS).cast("long")
    sx, sy, sxy = (F.col(c).cast("long") for c in ("_sx", "_sy", "_sxy"))
    vx = big_n * sx - sx * sx
    vy = big_n * sy - sy * sy
    r = (big_n * sxy - sx * sy).cast("double") / F.sqrt(vx.cast("double") * vy.cast("double"))
    autocorr = F.when((F.col("span_days") + 1 <= LAG_DAYS) | (vx == 0) | (vy == 0), F.lit(0.0)) \
                .otherwise(r)

    def rd(c):
        return round_to(c, decimals)

    return f.select(
        *KEYS,
        n.cast("long").alias("n_occurrences"),
        F.col("coverage_months").cast("long").alias("coverage_months"),
        F.when(n < 2, F.lit(0.0)).otherwise(median_gap).alias("median_gap_days"),
        rd(gap_cv).alias("gap_cv"),
        mode_day.cast("long").alias("day_of_month_mode"),
        rd(mode_rows / n).alias("dom_consistency"),
        rd(amean).alias("amount_mean"),
        rd(amount_cv).alias("amount_cv"),
        rd(iqr).alias("amount_iqr_ratio"),
        rd(autocorr).alias("autocorr_30d"),
        rd(F.coalesce(F.col("_neg"), F.lit(0)) / n).alias("share_negative"),
        F.col("span_days").cast("long").alias("span_days"))


# ---------------------------------------------------------------------------
# F10-F14 model
# ---------------------------------------------------------------------------

def finite_or_zero(features: DataFrame, cols=FEATURE_COLS) -> DataFrame:
    """+-Inf/NaN -> NULL -> 0 for every model input column."""
    out = features
    for c in cols:
        x = F.col(c).cast("double")
        out = out.withColumn(c, F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), None)
                             .otherwise(x))
    return out.fillna(0.0, subset=list(cols))


def label_known(features: DataFrame, seeds=SEED_MERCHANTS) -> DataFrame:
    """label 1 when the merchant contains any seed merchant."""
    hit = F.lit(False)
    for s in seeds:
        hit = hit | F.col("merchant").contains(s)
    return features.withColumn("label", hit.cast("double"))


def _split_flag(df: DataFrame, seed: int, holdout: float) -> DataFrame:
    """``_holdout`` for an exact share of each label (rounded; at least one row on each
    side where a label has two), by the order of a row hash. The rows are counted by
    ranges of the hash; only the one range per label that holds the cut is ranked."""
    u = F.xxhash64(*KEYS, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))
    rows = df.withColumn("_u", u).withColumn("_bin", F.shiftright("_u", 53 - SPLIT_BITS).cast("int"))
    to_here = Window.partitionBy("label").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_n").over(Window.partitionBy("label"))
    want = F.when(total < 2, 0).otherwise(F.greatest(F.lit(1), F.least(total - 1, F.round(total * holdout).cast("long"))))
    bins = (rows.groupBy("label", "_bin").agg(F.count(F.lit(1)).alias("_n"))
            .select("label", "_bin", (want - F.sum("_n").over(to_here) + F.col("_n")).alias("_room"), "_n"))
    rows = rows.join(bins, ["label", "_bin"])
    cut = (F.col("_room") > 0) & (F.col("_room") < F.col("_n"))
    inside = Window.partitionBy("label", "_bin").orderBy("_u", *KEYS)
    ranked = rows.filter(cut).withColumn("_holdout", F.row_number().over(inside) <= F.col("_room"))
    return (rows.filter(~cut).withColumn("_holdout", F.col("_room") >= F.col("_n"))
            .unionByName(ranked).drop("_u", "_bin", "_room", "_n"))


def train_subscription_model(features: DataFrame, holdout: float = 0.3, seed: int = 42,
                             max_iter: int = 200):
    """standardise (population std), balanced-weight L2 logistic
    regression with C = 1. Returns (PipelineModel, metrics dict).

    Raises ``ValueError`` when the labels have a single class."""
    data = written(_split_flag(finite_or_zero(features), seed, holdout), "training")
    classes = data.groupBy("label").count().collect()            # <= 2 rows
    if len(classes) < 2:
        raise ValueError("Training data has only one class; need positive and negative merchants.")
    train = data.filter(~F.col("_holdout"))
    test = data.filter(F.col("_holdout"))

    # balanced class weights n / (2 * n_c) over the training rows
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(counts) < 2:
        raise ValueError("Training data has only one class; need positive and negative merchants.")
    total = sum(counts.values())
    weights = {k: total / (2.0 * v) for k, v in counts.items()}
    wexpr = F.when(F.col("label") == 1.0, weights[1.0]).otherwise(weights[0.0])
    train = train.withColumn("weight", wexpr)

    # scaling parameters: one aggregate row (2 x 12 numbers)
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURE_COLS],
                      *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURE_COLS]).first()
    scaled = ", ".join(
        f"({c} - {stats[f'm_{c}']!r}) / {(stats[f's_{c}'] or 1.0) or 1.0!r} AS z_{c}"
        for c in FEATURE_COLS)
    scaler = SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")
    assembler = VectorAssembler(inputCols=[f"z_{c}" for c in FEATURE_COLS], outputCol="features")
    sum_w = float(total)  # sum of balanced weights equals the row count
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                            maxIter=max_iter, regParam=1.0 / sum_w, elasticNetParam=0.0,
                            standardization=False, tol=1e-10)
    model = Pipeline(stages=[scaler, assembler, lr]).fit(train)
    metrics = evaluate(model.transform(test)) if test.limit(1).count() else {}
    return model, metrics


def evaluation(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """one row with the ROC AUC of ``score`` for ``label`` (0/1) and precision, recall
    and F1 at ``threshold``. The AUC is the rank-sum statistic, equal scores counting half:
    rows are counted by score, the scores by range, so a positive's place among the
    negatives comes from two cumulative counts of integers, in any order of the rows. NULL
    without both labels; rows without a score or label don't count."""
    y = F.col("label") == 1
    rows = pred.filter("score is not null and label is not null").withColumn("score", F.col("score").cast("double"))
    counts = (rows.groupBy("score").agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
              .withColumn("range", F.floor(F.col("score") * SCORE_RANGES)))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = (counts.groupBy("range").agg(F.sum("neg").alias("n"))              # SCORE_RANGES rows or so
              .select("range", F.coalesce(F.sum("n").over(ahead(Window.orderBy("range"))), F.lit(0)).alias("below")))
    inside = F.coalesce(F.sum("neg").over(ahead(Window.partitionBy("range").orderBy("score"))), F.lit(0))
    won = counts.withColumn("inside", inside).join(ranges, "range").withColumn(
        "won", F.col("pos") * (2 * (F.col("below") + F.col("inside")) + F.col("neg")))
    over = F.col("score") >= threshold
    total = won.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("won").cast("decimal(38,0)")).alias("won"),
        F.sum(F.when(over, F.col("pos"))).alias("tp"), F.sum(F.when(over, F.col("neg"))).alias("fp"))
    tp, fp = (F.coalesce(c, F.lit(0)) for c in ("tp", "fp"))

    def share(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)
    return total.select(
        (F.col("won").cast("double") / 2 / F.nullif(F.col("p").cast("double") * F.col("n"), F.lit(0.0))).alias("auc"),
        share(tp, tp + fp).alias("precision"), share(tp, F.coalesce("p", F.lit(0))).alias("recall"),
        share(2 * tp, tp + fp + F.coalesce("p", F.lit(0))).alias("f1"))


def evaluate(pred: DataFrame, threshold: float = 0.5) -> dict:
    """:func:`evaluation` of a model's predictions."""
    return evaluation(pred.select("label", vector_to_array("probability")[1].alias("score")), threshold).first().asDict()


def score_subscriptions(features: DataFrame, model: PipelineModel) -> DataFrame:
    """probability of being a subscription, highest first."""
    x = features
    for c in FEATURE_COLS:                     # align columns: missing -> 0
        if c not in x.columns:
            x = x.withColumn(c, F.lit(0.0))
    x = finite_or_zero(x)
    out = model.transform(x).withColumn("score", vector_to_array("probability")[1])
    keep = ["account_id", "merchant", "score", "n_occurrences", "coverage_months",
            "median_gap_days", "dom_consistency", "amount_mean", "autocorr_30d"]
    return out.select(*keep).orderBy(F.desc("score"), *KEYS)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist the fitted pipeline (scaler, assembler, classifier)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---------------------------------------------------------------------------
# F15 / F16 cost and totals
# ---------------------------------------------------------------------------

def monthly_cost(subs: DataFrame) -> DataFrame:
    """|mean| x occurrences / months; else x 30 / median gap; else |mean|."""
    m = F.abs(F.col("amount_mean"))
    cost = (F.when(F.col("coverage_months") > 0,
                   m * (F.col("n_occurrences") / F.col("coverage_months")))
             .when(F.col("median_gap_days") > 0, m * (30.0 / F.col("median_gap_days")))
             .otherwise(m))
    return subs.withColumn("average_monthly_cost", round_cents(cost))


def subscription_totals(subs: DataFrame, expenses: DataFrame, threshold: float = 0.5) -> DataFrame:
    """F16: per account: subscriptions over ``threshold``, sum of rounded
    monthly costs, yearly = 12 x monthly, expense rows analysed."""
    s = (monthly_cost(subs).filter(F.col("score") >= threshold).groupBy("account_id")
         .agg(F.count(F.lit(1)).alias("total_subscriptions"),
              round_cents(F.sum("average_monthly_cost")).alias("total_monthly_cost")))
    n = expenses.groupBy("account_id").agg(F.count(F.lit(1)).alias("expense_transactions_analyzed"))
    return (n.join(s, "account_id", "left")
             .select("account_id", F.coalesce("total_subscriptions", F.lit(0)).alias("total_subscriptions"),
                     F.coalesce("total_monthly_cost", F.lit(0.0)).alias("total_monthly_cost"),
                     round_cents(F.coalesce("total_monthly_cost", F.lit(0.0)) * 12)
                      .alias("total_yearly_cost"),
                     "expense_transactions_analyzed"))
