"""Registered queries: name -> (Spark builder(spark, sf_dir), DuckDB oracle SQL or None).

Every builder reads the driver's tables through ``sources.testdata`` and runs
the library's operators over the whole tables. Integer outputs are BIGINT,
money/ratios DOUBLE, dates DATE, so both engines give the same schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..functions.numeric import round_to
from ..operators import periods as E
from ..sources import testdata as td
from . import oracle_sql as Q

Builder = Callable[[SparkSession, str], DataFrame]
# name -> (builder, maker of its oracle SQL or None); SQL texts are built only on demand
REGISTRY: dict[str, tuple[Builder, Callable[[], str] | None]] = {}


def register(name: str, sql: Callable[[], str] | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _ledger(spark, sf_dir, account="nation"):
    """Canonical ledger stand-in, stored once per data folder (see testdata.stored):
    ``nation`` / ``customer`` accounts over orders, or ``events`` (one account
    per user, 30 days of events)."""
    if account == "events":
        return td.ledger_events_table(spark, sf_dir)
    return td.ledger_orders_table(spark, sf_dir, account)


def _long(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


# ---------------------------------------------------------------------------
# E: period reports (flagship first)
# ---------------------------------------------------------------------------

@register("top_categories_90d", lambda: Q.categories_by_period(89, top=10))
def top_categories_90d(spark, sf_dir):
    """Top-10 spending categories per account over the last 90 days (E1+E4+E5)."""
    return _long(E.top_categories(E.categories_by_period(_ledger(spark, sf_dir), "90d"), 10), "rank")


@register("categories_by_period_30d", lambda: Q.categories_by_period(29))
def categories_by_period_30d(spark, sf_dir):
    return E.categories_by_period(_ledger(spark, sf_dir), "30d")


@register("categories_by_period_1y", lambda: Q.categories_by_period(364))
def categories_by_period_1y(spark, sf_dir):
    return E.categories_by_period(_ledger(spark, sf_dir), "1y")


@register("category_summary_14d", lambda: Q.category_summary(13))
def category_summary_14d(spark, sf_dir):
    return E.category_summary(_ledger(spark, sf_dir), "14d")


@register("daily_series_30d", lambda: Q.daily_series(30))
def daily_series_30d(spark, sf_dir):
    return E.daily_series(_ledger(spark, sf_dir), "30d")


@register("daily_series_1y", lambda: Q.daily_series(365))
def daily_series_1y(spark, sf_dir):
    return E.daily_series(_ledger(spark, sf_dir), "1y")


@register("series_summary_90d", lambda: Q.series_summary(90))
def series_summary_90d(spark, sf_dir):
    return E.series_summary(_ledger(spark, sf_dir), "90d")


@register("current_vs_prior", lambda: Q.current_vs_prior())
def current_vs_prior(spark, sf_dir):
    return E.current_vs_prior(_ledger(spark, sf_dir))


@register("category_deltas", lambda: Q.category_deltas())
def category_deltas(spark, sf_dir):
    return E.category_deltas(_ledger(spark, sf_dir))


@register("top_merchants", lambda: Q.top_merchants(5))
def top_merchants(spark, sf_dir):
    return _long(E.top_merchants(_ledger(spark, sf_dir), 5), "rank")


@register("largest_spending_day_90d", lambda: Q.largest_spending_day(90))
def largest_spending_day_90d(spark, sf_dir):
    return E.largest_spending_day(E.daily_series(_ledger(spark, sf_dir), "90d"))


@register("category_spend_lookup", lambda: Q.category_spend_lookup("STANDARD", 29))
def category_spend_lookup(spark, sf_dir):
    return E.category_spend_lookup(_ledger(spark, sf_dir), "STANDARD", "30d")


@register("share_of_total_90d", lambda: Q.share_of_total(89))
def share_of_total_90d(spark, sf_dir):
    top = E.top_categories(E.categories_by_period(_ledger(spark, sf_dir), "90d"), 10)
    return _long(E.share_of_total(top), "rank")


# ---------------------------------------------------------------------------
# D: account summary
# ---------------------------------------------------------------------------

from ..operators import summary as D  # noqa: E402


@register("account_totals", lambda: Q.account_totals())
def account_totals(spark, sf_dir):
    return D.account_totals(_ledger(spark, sf_dir))


@register("category_breakdown", lambda: Q.category_breakdown())
def category_breakdown(spark, sf_dir):
    return D.category_breakdown(_ledger(spark, sf_dir))


@register("date_range", lambda: Q.date_range())
def date_range(spark, sf_dir):
    return D.date_range(_ledger(spark, sf_dir))


@register("count_by_month", lambda: Q.count_by("month"))
def count_by_month(spark, sf_dir):
    return D.count_by_month(_ledger(spark, sf_dir))


@register("count_by_weekday", lambda: Q.count_by("weekday"))
def count_by_weekday(spark, sf_dir):
    return D.count_by_weekday(_ledger(spark, sf_dir))


@register("period_sums", lambda: Q.period_sums())
def period_sums(spark, sf_dir):
    return D.period_sums(_ledger(spark, sf_dir))


@register("trend", lambda: Q.trend())
def trend(spark, sf_dir):
    return D.trend(D.period_sums(_ledger(spark, sf_dir)))


@register("income_vs_spending", lambda: Q.income_vs_spending())
def income_vs_spending(spark, sf_dir):
    return D.income_vs_spending(_ledger(spark, sf_dir))


@register("top_categories_by_count", lambda: Q.top_categories_by_count(10))
def top_categories_by_count(spark, sf_dir):
    return D.top_categories_by_count(_ledger(spark, sf_dir), 10)


@register("category_distribution", lambda: Q.category_distribution())
def category_distribution(spark, sf_dir):
    return D.category_distribution(_ledger(spark, sf_dir))


@register("confidence_stats", lambda: Q.confidence_stats())
def confidence_stats(spark, sf_dir):
    return D.confidence_stats(_ledger(spark, sf_dir))


@register("uncategorized_rate", lambda: Q.uncategorized_rate())
def uncategorized_rate(spark, sf_dir):
    return D.uncategorized_rate(_ledger(spark, sf_dir))


@register("data_quality", lambda: Q.data_quality())
def data_quality(spark, sf_dir):
    return D.data_quality(_ledger(spark, sf_dir))


@register("file_profile", lambda: Q.file_profile(5))
def file_profile(spark, sf_dir):
    return D.file_profile(_ledger(spark, sf_dir), 5)


# ---------------------------------------------------------------------------
# F / C11: subscription features, costs, websites
# ---------------------------------------------------------------------------

from ..operators import subscriptions as S  # noqa: E402
from ..operators import websites as W  # noqa: E402


@register("merchant_features", lambda: Q.merchant_features())
def merchant_features(spark, sf_dir):
    """The 12 recurring-charge features per (account, merchant)."""
    return S.merchant_features(S.expense_projection(_ledger(spark, sf_dir)))


@register("subscription_costs", lambda: Q.subscription_costs())
def subscription_costs(spark, sf_dir):
    """F15 + C11 over every (account, merchant) candidate."""
    f = S.merchant_features(S.expense_projection(_ledger(spark, sf_dir)))
    return (W.attach_website(S.monthly_cost(f))
            .select("account_id", "merchant", "n_occurrences", "coverage_months",
                    "median_gap_days", "amount_mean", "average_monthly_cost", "website"))


#: stand-ins for the seed merchants: words of the driver's part names
SEED_WORDS = ("STEEL", "BRASS", "ALMOND", "RED")


@register("subscription_labels", lambda: Q.subscription_labels(SEED_WORDS))
def subscription_labels(spark, sf_dir):
    """F10 + F11: features without missing values, labelled by seed words."""
    f = S.merchant_features(S.expense_projection(_ledger(spark, sf_dir)))
    return S.label_known(S.finite_or_zero(f), SEED_WORDS).select(
        "account_id", "merchant", "median_gap_days", "amount_mean", "autocorr_30d", "label")


@register("subscription_totals", lambda: Q.subscription_totals(0.5))
def subscription_totals(spark, sf_dir):
    """F15 + F16 per account; the day-of-month consistency stands in for the score."""
    exp = S.expense_projection(_ledger(spark, sf_dir))
    subs = S.merchant_features(exp).withColumn("score", F.col("dom_consistency"))
    return S.subscription_totals(subs, exp, 0.5)


@register("confident_subscriptions", lambda: Q.confident_subscriptions(0.08))
def confident_subscriptions(spark, sf_dir):
    """Candidates at or over a score, the day-of-month consistency as the score."""
    f = S.merchant_features(S.expense_projection(_ledger(spark, sf_dir)))
    return (clean.confidence_filter(f.withColumn("score", F.col("dom_consistency")), 0.08)
            .select("account_id", "merchant", "score"))


@register("subscription_evaluation", lambda: Q.subscription_evaluation(SEED_WORDS, 0.1))
def subscription_evaluation(spark, sf_dir):
    """how well the day-of-month consistency finds the seed merchants (many ties)."""
    f = S.finite_or_zero(S.merchant_features(S.expense_projection(_ledger(spark, sf_dir))))
    pred = S.label_known(f, SEED_WORDS).withColumn("score", F.col("dom_consistency"))
    out = S.evaluation(pred, 0.1)
    return out.select(*[round_to(F.col(c), 9).alias(c) for c in out.columns])


@register("recent_merchant_features", lambda: Q.recent_merchant_features(E.CURRENT_DAYS))
def recent_merchant_features(spark, sf_dir):
    """The features of each account's last 30 days."""
    recent = E.window_last(_ledger(spark, sf_dir), E.CURRENT_DAYS)
    return S.merchant_features(S.expense_projection(recent))


@register("subscription_scores", None)
def subscription_scores(spark, sf_dir):
    """F12 + F14: a model fitted on the seed merchants, and every merchant's score."""
    f = S.written(S.merchant_features(S.expense_projection(_ledger(spark, sf_dir))), "features")
    model, _ = S.train_subscription_model(S.label_known(f, SEED_WORDS))
    return S.score_subscriptions(f, model).select("account_id", "merchant", round_to(F.col("score"), 4).alias("score"))


# ---------------------------------------------------------------------------
# G: savings goals
# ---------------------------------------------------------------------------


@register("validate_goals", lambda: Q.validate_goals())
def validate_goals(spark, sf_dir):
    """One requested goal per customer; only customers with orders have accounts."""
    accounts = _ledger(spark, sf_dir, "customer")
    return clean.validate_goals(td.requested_goals(spark, sf_dir), accounts)

from ..operators import savings as G  # noqa: E402


@register("monthly_averages", lambda: Q.monthly_averages())
def monthly_averages(spark, sf_dir):
    return G.monthly_averages(_ledger(spark, sf_dir))


@register("category_monthly_spend", lambda: Q.category_monthly_spend())
def category_monthly_spend(spark, sf_dir):
    """G1 per category + G2 cut priority."""
    return G.category_monthly_spend(_ledger(spark, sf_dir))


def _goal_analysis(spark, sf_dir):
    return G.analyze_goals(_ledger(spark, sf_dir), td.goals(spark, sf_dir))


@register("savings_plan", lambda: Q.savings_plan())
def savings_plan(spark, sf_dir):
    """G3-G6 per goal (cuts counted; strategies counted)."""
    a = _goal_analysis(spark, sf_dir)
    return a.select("goal_id", "account_id", "target_amount", "months", "monthly_target",
                    "monthly_income", "monthly_expenses", "monthly_savings", "can_achieve_goal",
                    "shortfall", "total_suggested_savings", "remaining_shortfall",
                    F.size("alternative_strategies").alias("n_strategies"),
                    "total_categories_analyzed", "high_priority_cuts", "achievable_with_cuts")


@register("savings_cuts", lambda: Q.savings_cuts())
def savings_cuts(spark, sf_dir):
    """G3 cut table: one row per suggested cut in plan order."""
    return G.explode_cuts(_goal_analysis(spark, sf_dir))


@register("top_levers", lambda: Q.top_levers())
def top_levers(spark, sf_dir):
    return G.top_levers(_ledger(spark, sf_dir))


# ---------------------------------------------------------------------------
# H: net worth (households from customer; optimised scenario uses levers of
# the per-customer ledger)
# ---------------------------------------------------------------------------

from ..operators import networth as H  # noqa: E402

START_MONTH = "2025-01"


def _households(spark, sf_dir):
    return td.households(spark, sf_dir)


def _lever_savings(spark, sf_dir):
    return G.lever_savings(G.top_levers(_ledger(spark, sf_dir, "customer")))


@register("net_worth", lambda: Q.net_worth())
def net_worth(spark, sf_dir):
    """H1/H2: current assets, liabilities, net worth per household."""
    return H.net_worth(H.with_defaults(_households(spark, sf_dir))).select(
        "account_id", "assets_total", "liabilities_total", "net_worth")


@register("flow_summary", lambda: Q.flow_summary())
def flow_summary(spark, sf_dir):
    return H.flow_summary(_households(spark, sf_dir))


@register("projection_10y", lambda: Q.projection(120))
def projection_10y(spark, sf_dir):
    """H3-H5: month-by-month balances for 10 years (121 rows per household)."""
    return H.project_net_worth(_households(spark, sf_dir), 120, start_month=START_MONTH)


@register("horizons", lambda: Q.horizons())
def horizons(spark, sf_dir):
    """H6: 3m..50y from one 600-month projection."""
    return H.horizons(_households(spark, sf_dir), START_MONTH)


@register("optimized_projection", lambda: Q.optimized_projection())
def optimized_projection(spark, sf_dir):
    """G7 + H8: lever savings added to retirement contributions, both scenarios."""
    return H.optimized_projection(_households(spark, sf_dir), _lever_savings(spark, sf_dir), START_MONTH)


@register("growth_stats_5y", lambda: Q.growth_stats(60))
def growth_stats_5y(spark, sf_dir):
    """H9 over the 5-year frame."""
    return H.growth_stats(_households(spark, sf_dir), _lever_savings(spark, sf_dir), 60, START_MONTH)


@register("downsample_20y", lambda: Q.downsample(240, H.downsample_step(240)))
def downsample_20y(spark, sf_dir):
    """Every 4th month of the 20-year series, 'Mon yyyy' labels."""
    step = H.downsample_step(240)
    proj = H.project_net_worth(_households(spark, sf_dir), 240, range(0, 241, step), START_MONTH)
    return H.downsample(proj, 240)


# ---------------------------------------------------------------------------
# I: money-priority plan
# ---------------------------------------------------------------------------

from ..operators import priorities as I  # noqa: E402


def _plan(spark, sf_dir):
    disc = I.discretionary(_ledger(spark, sf_dir, "customer"))
    return I.priority_plan(td.priority_answers(spark, sf_dir), disc)


@register("priority_rows", lambda: Q.priority_rows())
def priority_rows(spark, sf_dir):
    """Four priority rows per household (texts counted)."""
    return (I.priority_rows(_plan(spark, sf_dir))
            .select("account_id", "priority", "name", "current_amount", "target_amount",
                    "monthly_allocation", "months_to_complete", "status",
                    F.size("recommendations").alias("n_recommendations")))


@register("priority_advice", lambda: Q.priority_advice())
def priority_advice(spark, sf_dir):
    """Description and advice texts of every priority, in their order."""
    return (I.priority_rows(_plan(spark, sf_dir))
            .select("account_id", "priority", "description", F.posexplode("recommendations").alias("place", "advice"))
            .withColumn("place", F.col("place").cast("long")))


@register("priority_plan", lambda: Q.priority_plan())
def priority_plan(spark, sf_dir):
    """Plan totals per household."""
    return _plan(spark, sf_dir).drop("priorities")


# ---------------------------------------------------------------------------
# C: categorisation (index trained on part names labelled by part type)
# ---------------------------------------------------------------------------

from ..operators import categorize as C  # noqa: E402


def _index(spark, sf_dir):
    return C.fit_tfidf(C.training_table(td.category_training(spark, sf_dir)))


def _stored_index(spark, sf_dir):
    """The index as reports use it: fitted once per data folder and loaded."""
    folder = td.stored(spark, sf_dir, "category_index", lambda: _index(spark, sf_dir), td.TRAINING_INPUTS,
                       writer=C.save_index, done="postings/_SUCCESS")
    return C.load_index(spark, folder)


@register("category_vocabulary", lambda: Q.category_vocabulary())
def category_vocabulary(spark, sf_dir):
    """Vocabulary (top 30 000 uni/bi-grams) with smooth idf, reported to
    12 decimals (the two engines' ``ln`` may differ in the last bit)."""
    vocab, _ = _index(spark, sf_dir)
    return vocab.select("term", round_to(F.col("idf"), 12).alias("idf"))


@register("knn_predictions", lambda: Q.knn_predictions(7, 0.25))
def knn_predictions(spark, sf_dir):
    """C6-C8 + C10: label and confidence of every distinct ledger description."""
    return C.predict_category(_ledger(spark, sf_dir).select("description"), _stored_index(spark, sf_dir))


@register("categorized_summary", lambda: Q.categorized_summary(5, 0.35))
def categorized_summary(spark, sf_dir):
    """Categorise the whole ledger, then rows/amount/confidence per category."""
    led = _ledger(spark, sf_dir).drop("category", "confidence")
    cat = C.categorize(led, _stored_index(spark, sf_dir))
    return cat.groupBy("account_id", "category").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("amount").cast("double").alias("total_amount"),
        round_to(F.avg("confidence"), 6).alias("mean_confidence"))


# ---------------------------------------------------------------------------
# Insight facts and card validation
# ---------------------------------------------------------------------------

from ..operators import insights as N  # noqa: E402


@register("insight_facts", lambda: Q.insight_fact_rows())
def insight_facts(spark, sf_dir):
    """Cash flow, six largest category deltas, five top merchants."""
    return N.insight_fact_rows(N.insight_facts(_ledger(spark, sf_dir)))


@register("validate_cards", lambda: Q.validate_cards())
def validate_cards(spark, sf_dir):
    """Schema check of card payloads (templated from the facts, plus every turn of the
    conversations); an invalid payload yields no cards."""
    return _cards(spark, sf_dir).select("source", "role", "source_id", "valid", F.size("cards").alias("n_cards"))


def _cards(spark, sf_dir):
    facts = N.insight_facts(_ledger(spark, sf_dir))
    return N.validate_cards(td.card_payloads(spark, sf_dir, facts))


@register("card_rows", lambda: Q.card_rows())
def card_rows(spark, sf_dir):
    """The accepted cards themselves, one row each."""
    v = _cards(spark, sf_dir).select("source", "role", "source_id", F.posexplode("cards").alias("place", "c"))
    return v.select("source", "role", "source_id", F.col("place").cast("long").alias("place"), "c.kind", "c.title",
                    "c.summary", "c.period", round_to(F.col("c.impact"), 2).alias("impact"))


@register("events_json", lambda: Q.events_json())
def events_json(spark, sf_dir):
    """Events with a ratio that may be infinite or NaN and times with fractions, as
    plain JSON values, also inside an array and a struct."""
    e = td.table(spark, sf_dir, "events")
    with_ratio = e.select("event_id", "ts", "value",
                          F.when(F.col("event_id") % 3 == 0, F.lit(float("inf"))).when(F.col("event_id") % 3 == 1, F.lit(float("nan")))
                          .otherwise(F.col("value")).alias("ratio"))
    nested = with_ratio.withColumn("both", F.array("value", "ratio")).withColumn("at", F.struct("ts", "ratio"))
    out = clean.json_safe(nested)
    return out.select("event_id", "ts", "ratio", F.to_json("both").alias("both"), F.col("at.ts").alias("at_ts"),
                      F.col("at.ratio").alias("at_ratio"))


@register("savings_strategies", lambda: Q.savings_strategies())
def savings_strategies(spark, sf_dir):
    """The strategy texts of every goal, in their order."""
    return _goal_analysis(spark, sf_dir).select(
        "goal_id", F.posexplode("alternative_strategies").alias("place", "strategy")) \
        .withColumn("place", F.col("place").cast("long"))


# ---------------------------------------------------------------------------
# The same operators over the events ledger (one account per user)
# ---------------------------------------------------------------------------

@register("events_account_totals", lambda: Q.account_totals("events"))
def events_account_totals(spark, sf_dir):
    return D.account_totals(_ledger(spark, sf_dir, "events"))


@register("events_daily_series_14d", lambda: Q.daily_series(14, "events"))
def events_daily_series_14d(spark, sf_dir):
    return E.daily_series(_ledger(spark, sf_dir, "events"), "14d")


@register("events_category_summary_14d", lambda: Q.category_summary(13, "events"))
def events_category_summary_14d(spark, sf_dir):
    return E.category_summary(_ledger(spark, sf_dir, "events"), "14d")


@register("events_current_vs_prior", lambda: Q.current_vs_prior("events"))
def events_current_vs_prior(spark, sf_dir):
    return E.current_vs_prior(_ledger(spark, sf_dir, "events"))


@register("events_top_merchants", lambda: Q.top_merchants(5, "events"))
def events_top_merchants(spark, sf_dir):
    return _long(E.top_merchants(_ledger(spark, sf_dir, "events"), 5), "rank")


@register("events_merchant_features", lambda: Q.merchant_features("events"))
def events_merchant_features(spark, sf_dir):
    """F1-F9 per (user, event type)."""
    return S.merchant_features(S.expense_projection(_ledger(spark, sf_dir, "events")))


# ---------------------------------------------------------------------------
# A1 + A6: CSV export and re-read through the ledger reader
# ---------------------------------------------------------------------------

from ..sources import ingest as A  # noqa: E402


@register("csv_roundtrip_totals", lambda: Q.account_totals())
def csv_roundtrip_totals(spark, sf_dir):
    """A6 export -> A1 read (header probe, B1 roles, B2/B3 parsing) -> D1:
    the totals must equal those of the ledger itself."""
    folder = td.ledger_csv_export(spark, sf_dir)
    return D.account_totals(A.read_ledgers(spark, folder, account_from="partition"))


def _upload() -> F.Column:
    return F.regexp_extract("path", r"account_id=([^/]+)/", 1)


@register("remaining_totals", lambda: Q.remaining_totals())
def remaining_totals(spark, sf_dir):
    """A5: one account removed from the ledger and the registry; totals of the accounts
    that both still hold."""
    led = _ledger(spark, sf_dir)
    files = led.select("account_id").distinct()
    first = led.agg(F.min("account_id")).first()[0]          # one value
    files, led = A.remove_account(files, led, first)
    return led.join(files, "account_id", "left_semi").groupBy("account_id").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("amount").cast("double").alias("total_amount"))


@register("upload_status", lambda: Q.upload_status())
def upload_status(spark, sf_dir):
    """A4 over a folder of good, copied, ragged, broken and foreign files."""
    files = A.classify_files(spark, td.upload_files(spark, sf_dir))
    return _long(files.filter("length > 0").select(_upload().alias("upload"), "status", "rows", "columns"), "rows", "columns")


@register("upload_catalog", lambda: Q.upload_catalog())
def upload_catalog(spark, sf_dir):
    """A3: rows of every stored CSV file, broken ones too."""
    files = A.file_catalog(spark, td.upload_files(spark, sf_dir))
    return files.select(F.regexp_extract("filename", r"[.](\w+)$", 1).alias("kind"), "rows") \
                .groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))


@register("upload_duplicates", lambda: Q.upload_duplicates())
def upload_duplicates(spark, sf_dir):
    """A2: equal files of each account and its copies."""
    files = A.hash_files(spark, td.upload_files(spark, sf_dir))
    seen = A.dedup_files(files, spark.createDataFrame([], A.REGISTRY_SCHEMA))
    return seen.groupBy(F.regexp_replace(_upload(), "^copy-", "").alias("upload")).agg(
        F.count(F.lit(1)).alias("files"), F.count_if("is_duplicate").alias("duplicates"))


@register("ingested_totals", lambda: Q.ingested_totals())
def ingested_totals(spark, sf_dir):
    """A8 over the same folder, then the totals of what the stream accepted (copies under
    either name, whichever came first)."""
    import uuid

    from ..session import checkpoint_dir
    from ..streaming.ingest_stream import ingest_stream
    base = f"{checkpoint_dir(spark).rstrip('/')}/ledgerspark-ingest-{uuid.uuid4().hex}"
    run = ingest_stream(spark, td.upload_files(spark, sf_dir) + "/*", base + "/ledger", base + "/registry",
                        base + "/stream", max_files=10, account_from="partition")
    run.awaitTermination()
    return spark.read.parquet(base + "/ledger").groupBy(F.regexp_replace("account_id", "^copy-", "").alias("account_id")).agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("amount").cast("double").alias("total_amount"),
        F.sum(F.char_length("description")).alias("letters"), F.max("txn_date").alias("last_date"))
