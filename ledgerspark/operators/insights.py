"""Insight inputs and card validation.

``insight_facts`` gathers, per account, what the reference hands to its text
generator: 30-day cash flow, prior net, the six largest category deltas, the
five most frequent merchants and up to six subscriptions. ``validate_cards``
checks generated card payloads against the fixed card schema with Spark's
VARIANT functions (``try_parse_json``, ``schema_of_variant``): any violation
empties the whole batch, as in the reference.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import periods as E
from . import subscriptions as S

# ---------------------------------------------------------------------------
# Card schema (kinds and string length limits) and fact sizes.
# ---------------------------------------------------------------------------
CARD_KINDS = ["cashflow", "category_trend", "subscription", "anomaly", "merchant", "runway", "action"]
REQUIRED_CARD_KEYS = ["kind", "title", "summary", "period", "metrics"]
MAX_LEN = {"title": 120, "summary": 280, "period": 40}
TOP_DELTAS, TOP_MERCHANTS, TOP_SUBSCRIPTIONS = 6, 5, 6
TIME_RANGE = "Last 30d"
RECENT_SUBSCRIPTION_THRESHOLD = 0.5


def recent_subscriptions(txn: DataFrame, model: PipelineModel,
                         threshold: float = RECENT_SUBSCRIPTION_THRESHOLD) -> DataFrame:
    """Subscription scoring restricted to each account's last 30 days."""
    recent = E.window_last(txn, E.CURRENT_DAYS).drop("period_start", "period_end")
    feats = S.merchant_features(S.expense_projection(recent))
    scored = S.score_subscriptions(feats, model)
    return scored.filter(F.col("score") >= threshold).select(
        "account_id", "merchant", "score", "amount_mean", "n_occurrences")


def _top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("account_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def insight_facts(txn: DataFrame, subscriptions: DataFrame | None = None) -> DataFrame:
    """One row per account with the generator inputs as nested columns."""
    # one 58-day window of day rows feeds cash flow and deltas
    windowed = E._current_prior(txn)
    cash = E.current_vs_prior(txn, windowed).select(
        "account_id", F.col("current_income").alias("income"),
        F.col("current_expenses").alias("expenses"), F.col("current_net").alias("net"),
        "prior_net", "net_change")
    deltas = _top(E.category_deltas(txn, windowed), TOP_DELTAS,
                  F.desc(F.abs("delta_amount")), F.asc("category"))
    merchants = E.top_merchants(txn, TOP_MERCHANTS)

    def nest(df, name, fields):
        return (df.groupBy("account_id")
                  .agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias(name)))
    out = (cash.join(nest(deltas, "category_deltas",
                          ["category", "current_amount", "prior_amount", "delta_amount"]),
                     "account_id", "left")
               .join(nest(merchants, "top_merchants", ["merchant", "count", "total_amount"]),
                     "account_id", "left"))
    if subscriptions is not None:
        subs = _top(subscriptions, TOP_SUBSCRIPTIONS, F.desc("score"), F.asc("merchant")) \
            .withColumnRenamed("amount_mean", "amount")
        out = out.join(nest(subs, "subs_summary", ["merchant", "score", "amount"]), "account_id", "left")
    else:
        out = out.withColumn("subs_summary", F.array().cast(
            "array<struct<rank:bigint,merchant:string,score:double,amount:double>>"))
    return out.select("account_id", F.lit(TIME_RANGE).alias("time_range"), "income", "expenses",
                      "net", "prior_net", "net_change", "category_deltas", "top_merchants",
                      "subs_summary", F.lit(None).cast("double").alias("cash_balance"))


def insight_fact_rows(facts: DataFrame) -> DataFrame:
    """Flat form: (account_id, section, rank, name, value_1, value_2, value_3)."""
    cash = facts.select("account_id", F.lit("cashflow").alias("section"), F.lit(0).cast("long").alias("rank"),
                        F.lit(None).cast("string").alias("name"), F.col("income").alias("value_1"),
                        F.col("expenses").alias("value_2"), F.col("prior_net").alias("value_3"))
    d = (facts.select("account_id", F.explode("category_deltas").alias("d"))
              .select("account_id", F.lit("category_delta").alias("section"), "d.rank",
                      F.col("d.category").alias("name"), F.col("d.current_amount").alias("value_1"),
                      F.col("d.prior_amount").alias("value_2"), F.col("d.delta_amount").alias("value_3")))
    m = (facts.select("account_id", F.explode("top_merchants").alias("m"))
              .select("account_id", F.lit("merchant").alias("section"), "m.rank",
                      F.col("m.merchant").alias("name"), F.col("m.count").cast("double").alias("value_1"),
                      F.col("m.total_amount").alias("value_2"), F.lit(None).cast("double").alias("value_3")))
    s = (facts.select("account_id", F.explode("subs_summary").alias("s"))
              .select("account_id", F.lit("subscription").alias("section"), "s.rank",
                      F.col("s.merchant").alias("name"), F.col("s.score").alias("value_1"),
                      F.col("s.amount").alias("value_2"), F.lit(None).cast("double").alias("value_3")))
    return cash.unionByName(d).unionByName(m).unionByName(s)


# ---------------------------------------------------------------------------
# E12 card validation
# ---------------------------------------------------------------------------

def _type(v: Column, path: str) -> Column:
    """JSON type of a field: STRING, BIGINT, DOUBLE, DECIMAL(p,s), OBJECT<..>,
    ARRAY<..>, BOOLEAN, VOID (JSON null); NULL when the key is absent."""
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def _is_number(t: Column) -> Column:
    return t.isin("BIGINT", "DOUBLE") | t.startswith("DECIMAL")


def _card_ok(c: Column) -> Column:
    ok = F.schema_of_variant(c).startswith("OBJECT")
    for k in REQUIRED_CARD_KEYS:
        ok = ok & _type(c, f"$.{k}").isNotNull()
    ok = ok & (_type(c, "$.kind") == "STRING") & \
        F.variant_get(c, "$.kind", "string").isin(*CARD_KINDS)
    for k, n in MAX_LEN.items():
        ok = ok & (_type(c, f"$.{k}") == "STRING") & \
            (F.char_length(F.variant_get(c, f"$.{k}", "string")) <= n)
    t_imp, t_cta = _type(c, "$.impact"), _type(c, "$.cta")
    ok = ok & (t_imp.isNull() | _is_number(t_imp) | (t_imp == "VOID"))
    ok = ok & _type(c, "$.metrics").startswith("OBJECT")
    ok = ok & (t_cta.isNull() | t_cta.startswith("OBJECT") | (t_cta == "VOID"))
    return F.coalesce(ok, F.lit(False))


CARD_TYPE = ("array<struct<kind:string,title:string,summary:string,impact:double,"
             "period:string,metrics:string,cta:string>>")


def validate_cards(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Adds ``valid`` and ``cards`` (empty unless the whole payload is valid):
    a JSON object whose only key is ``cards``, an array of card objects each
    with kind in the fixed list, string title/summary/period within their
    lengths, numeric-or-null impact, object metrics, object-or-null cta."""
    raw = F.col(col)
    v = F.try_parse_json(raw)
    items = F.variant_get(v, "$.cards", "array<variant>")
    top_ok = (v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
              & (F.size(F.array_distinct(F.json_object_keys(raw))) == 1)
              & F.array_contains(F.json_object_keys(raw), "cards")
              & _type(v, "$.cards").startswith("ARRAY"))
    valid = F.coalesce(top_ok & F.forall(items, _card_ok), F.lit(False))
    parsed = F.transform(items, lambda c: F.struct(
        F.variant_get(c, "$.kind", "string").alias("kind"),
        F.variant_get(c, "$.title", "string").alias("title"),
        F.variant_get(c, "$.summary", "string").alias("summary"),
        F.try_variant_get(c, "$.impact", "double").alias("impact"),
        F.variant_get(c, "$.period", "string").alias("period"),
        F.to_json(F.variant_get(c, "$.metrics", "variant")).alias("metrics"),
        F.to_json(F.variant_get(c, "$.cta", "variant")).alias("cta")))
    return (payloads.withColumn("valid", valid)
                    .withColumn("cards", F.when(F.col("valid"), parsed)
                                .otherwise(F.array().cast(CARD_TYPE)).cast(CARD_TYPE)))
