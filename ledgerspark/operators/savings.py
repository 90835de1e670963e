"""Savings goals.

Monthly averages are one partial aggregate per (account, category). The
greedy cut plan is a per-account fold over that account's categories --
``sort_array(collect_list(struct))`` then the ``aggregate`` higher-order
function -- so it stays JVM-side; the collected list has one entry per
category (bounded by the category vocabulary), never one per transaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import INCOME, exclude_category
from .periods import CURRENT_DAYS, SAVINGS_DAYS, money, window_days

# ---------------------------------------------------------------------------
# Cut-priority keywords (matched as substrings of the lower-cased
# category, first list wins), reduction caps per priority, amount thresholds,
# months in the averaging window, strategy texts.
# ---------------------------------------------------------------------------
HIGH_PRIORITY = ["entertainment", "dining", "shopping", "recreation", "hobbies",
                 "subscriptions", "luxury", "personal_care", "clothing", "travel"]
MEDIUM_PRIORITY = ["utilities", "transportation", "groceries", "healthcare",
                   "insurance", "communication", "education"]
LOW_PRIORITY = ["rent", "mortgage", "debt_payment", "savings", "investment",
                "income", "taxes", "essential"]
REDUCTION_CAP = {1: 0.5, 2: 0.3, 3: 0.15, 4: 0.1}
MIN_REDUCTION_PCT = 0.05
AVERAGE_MONTHS = 3
NO_DATA_MESSAGE = "Unable to analyze spending patterns - check data format"
STRATEGIES_OVER_1000 = ["Consider increasing income through side hustles or freelance work",
                        "Look for higher-paying job opportunities"]
STRATEGIES_OVER_500 = ["Sell unused items or assets to generate one-time income",
                       "Consider temporary part-time work"]
STRATEGIES_OVER_200 = ["Extend the savings timeline to reduce monthly pressure",
                       "Look for ways to reduce fixed costs (utilities, insurance, etc.)"]
STRATEGIES_ALWAYS = ["Consider a more aggressive investment strategy for existing savings",
                     "Look for government assistance programs or tax benefits"]
LEVER_COUNT = 3
LEVER_PCT = 0.2


# ---------------------------------------------------------------------------
# G1 / G2
# ---------------------------------------------------------------------------

def monthly_averages(txn: DataFrame) -> DataFrame:
    """G1 totals: last 90 days / 3 -> income, |expenses|, net per account."""
    t = window_days(txn, SAVINGS_DAYS)
    inc = F.coalesce(F.sum("inflow"), F.lit(0)).cast("double") / AVERAGE_MONTHS
    exp = F.abs(F.coalesce(F.sum("outflow"), F.lit(0))).cast("double") / AVERAGE_MONTHS
    return t.groupBy("account_id").agg(
        inc.alias("monthly_income"), exp.alias("monthly_expenses"),
        (inc - exp).alias("monthly_net"))


def cut_priority(category: Column | str, amount: Column | str) -> Column:
    """1 (discretionary) .. 4; keyword lists first, then the amount."""
    c = F.lower(F.col(category) if isinstance(category, str) else category)
    amt = F.col(amount) if isinstance(amount, str) else amount

    def any_of(words):
        hit = F.lit(False)
        for w in words:
            hit = hit | c.contains(w)
        return F.coalesce(hit, F.lit(False))
    return (F.when(any_of(HIGH_PRIORITY), 1).when(any_of(MEDIUM_PRIORITY), 2)
             .when(any_of(LOW_PRIORITY), 3).when(amt > 500, 2).when(amt > 200, 3)
             .otherwise(4))


def category_monthly_spend(txn: DataFrame) -> DataFrame:
    """G1 per category: |sum of negative amounts| / 3, with its cut priority."""
    t = window_days(txn, SAVINGS_DAYS, "category")
    g = t.groupBy("account_id", "category").agg(
        (F.abs(F.sum("outflow")).cast("double") / AVERAGE_MONTHS).alias("monthly_amount"))
    return (g.filter(F.col("monthly_amount") > 0)
             .withColumn("priority", cut_priority("category", "monthly_amount")))


# ---------------------------------------------------------------------------
# G3-G6
# ---------------------------------------------------------------------------

def _cap(priority: Column) -> Column:
    return (F.when(priority == 1, REDUCTION_CAP[1]).when(priority == 2, REDUCTION_CAP[2])
             .when(priority == 3, REDUCTION_CAP[3]).otherwise(REDUCTION_CAP[4]))


def plan_cuts(spend: DataFrame, goals: DataFrame) -> DataFrame:
    """Greedy cuts per goal. Categories in (priority asc, amount desc,
    category asc) order; pct = min(cap, remaining / amount, 1); a category is
    taken only when pct > 5 % (smaller ones are skipped and the walk goes on);
    the walk stops once remaining <= 0.

    ``goals`` needs (goal_id, account_id, shortfall). Returns goal_id and an
    array ``cuts`` of (category, current_monthly, suggested_monthly,
    reduction_amount, reduction_percentage, priority)."""
    cats = (spend.groupBy("account_id")
                 .agg(F.array_sort(F.collect_list(F.struct(
                     F.col("priority").alias("p"), (-F.col("monthly_amount")).alias("neg_amount"),
                     F.col("category").alias("category"),
                     F.col("monthly_amount").alias("amount")))).alias("cats")))
    g = goals.select("goal_id", "account_id", "shortfall").join(cats, "account_id", "left")
    cut_t = ("struct<category:string,current_monthly:double,suggested_monthly:double,"
             "reduction_amount:double,reduction_percentage:double,priority:int>")
    init = F.struct(F.col("shortfall").cast("double").alias("remaining"),
                    F.array().cast(f"array<{cut_t}>").alias("cuts"))

    def step(acc, c):
        pct = F.least(_cap(c["p"]), acc["remaining"] / c["amount"], F.lit(1.0))
        red = c["amount"] * pct
        cut = F.struct(c["category"].alias("category"), c["amount"].alias("current_monthly"),
                       (c["amount"] - red).alias("suggested_monthly"),
                       red.alias("reduction_amount"), (pct * 100).alias("reduction_percentage"),
                       c["p"].cast("int").alias("priority"))
        take = (acc["remaining"] > 0) & (pct > MIN_REDUCTION_PCT)
        return F.when(take, F.struct((acc["remaining"] - red).alias("remaining"),
                                     F.concat(acc["cuts"], F.array(cut)).alias("cuts"))) \
                .otherwise(acc)
    walk = F.aggregate(F.coalesce("cats", F.array().cast(
        "array<struct<p:int,neg_amount:double,category:string,amount:double>>")), init, step)
    return g.select("goal_id", F.when(F.col("shortfall") > 0, walk["cuts"])
                    .otherwise(F.array().cast(f"array<{cut_t}>")).alias("cuts"))


def alternative_strategies(remaining: Column, months: Column) -> Column:
    """Strategy texts; ``remaining`` is already monthly and is divided by
    the months again, as in the reference."""
    per = remaining / months

    def arr(xs):
        return F.array(*[F.lit(x) for x in xs])
    empty = F.array().cast("array<string>")
    return F.when(remaining > 0, F.concat(
        F.when(per > 1000, arr(STRATEGIES_OVER_1000)).otherwise(empty),
        F.when(per > 500, arr(STRATEGIES_OVER_500)).otherwise(empty),
        F.when(per > 200, arr(STRATEGIES_OVER_200)).otherwise(empty),
        arr(STRATEGIES_ALWAYS))).otherwise(empty)


def analyze_goals(txn: DataFrame, goals: DataFrame) -> DataFrame:
    """G4 + G5 + G6 per goal (goal_id, account_id, target_amount, months).

    Accounts without usable rows in the last 90 days get zeros, the whole
    monthly target as shortfall and the single no-data message."""
    avg = monthly_averages(txn).withColumn("_has", F.lit(True))
    g = (goals.join(avg, "account_id", "left")
              .withColumn("monthly_target", F.col("target_amount") / F.col("months")))
    has = F.coalesce(F.col("_has"), F.lit(False))
    g = (g.withColumn("monthly_income", F.when(has, F.col("monthly_income")).otherwise(0.0))
          .withColumn("monthly_expenses", F.when(has, F.col("monthly_expenses")).otherwise(0.0))
          .withColumn("monthly_savings", F.when(has, F.col("monthly_net")).otherwise(0.0))
          .withColumn("can_achieve_goal", has & (F.col("monthly_net") >= F.col("monthly_target")))
          .withColumn("shortfall", F.when(has, F.greatest(F.lit(0.0),
                                                          F.col("monthly_target") - F.col("monthly_net")))
                                    .otherwise(F.col("monthly_target"))))
    cuts = plan_cuts(category_monthly_spend(txn),
                     g.filter(has).select("goal_id", "account_id", "shortfall"))
    g = g.join(cuts, "goal_id", "left")
    cut_sum = F.aggregate(F.coalesce("cuts", F.array().cast(
        "array<struct<category:string,current_monthly:double,suggested_monthly:double,"
        "reduction_amount:double,reduction_percentage:double,priority:int>>")),
        F.lit(0.0), lambda acc, c: acc + c["reduction_amount"])
    g = (g.withColumn("cuts", F.coalesce("cuts", F.array().cast(
              "array<struct<category:string,current_monthly:double,suggested_monthly:double,"
              "reduction_amount:double,reduction_percentage:double,priority:int>>")))
          .withColumn("total_suggested_savings", cut_sum)
          .withColumn("remaining_shortfall",
                      F.when(has, F.greatest(F.lit(0.0), F.col("shortfall") - cut_sum))
                       .otherwise(F.col("monthly_target"))))
    strategies = F.when(has, alternative_strategies(F.col("remaining_shortfall"), F.col("months"))) \
                  .otherwise(F.array(F.lit(NO_DATA_MESSAGE)))
    return g.select(
        "goal_id", "account_id", "target_amount", "months", "monthly_target",
        "monthly_income", "monthly_expenses", "monthly_savings",
        F.coalesce("can_achieve_goal", F.lit(False)).alias("can_achieve_goal"),
        "shortfall", "cuts", "total_suggested_savings", "remaining_shortfall",
        strategies.alias("alternative_strategies"),
        # G6 summary
        F.size("cuts").cast("long").alias("total_categories_analyzed"),
        F.size(F.filter("cuts", lambda c: c["priority"] == 1)).cast("long").alias("high_priority_cuts"),
        (F.col("remaining_shortfall") <= 0).alias("achievable_with_cuts"))


def explode_cuts(analysis: DataFrame) -> DataFrame:
    """Table form of the cuts: one row per (goal, cut) with its order."""
    return (analysis.select("goal_id", "account_id", F.posexplode("cuts").alias("pos", "c"))
            .select("goal_id", "account_id", (F.col("pos") + 1).cast("long").alias("cut_order"),
                    "c.*"))


# ---------------------------------------------------------------------------
# G7
# ---------------------------------------------------------------------------

def top_levers(txn: DataFrame, n: int = LEVER_COUNT, pct: float = LEVER_PCT) -> DataFrame:
    """Top ``n`` spending categories of the last 30 days (no Income, nothing
    whose category contains 'rent') with a ``pct`` reduction each."""
    t = window_days(txn, CURRENT_DAYS, "category")
    t = exclude_category(t.filter(~F.col("income")), "rent", "contains")
    g = t.groupBy("account_id", "category").agg(
        money(F.abs(F.sum("amount"))).alias("current_spending"))
    w = Window.partitionBy("account_id").orderBy(F.desc("current_spending"), F.asc("category"))
    return (g.withColumn("rank", F.row_number().over(w).cast("long"))
             .filter(F.col("rank") <= n)
             .withColumn("suggested_reduction", F.col("current_spending") * pct)
             .withColumn("new_spending", F.col("current_spending") * (1 - pct)))


def lever_savings(levers: DataFrame) -> DataFrame:
    """Monthly savings per account = sum of the lever reductions, added in
    rank order (a fixed order keeps the floating-point sum reproducible)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "suggested_reduction")))
    return levers.groupBy("account_id").agg(
        F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x["suggested_reduction"])
         .alias("monthly_savings"))


__all__ = ["monthly_averages", "cut_priority", "category_monthly_spend", "plan_cuts",
           "alternative_strategies", "analyze_goals", "explode_cuts", "top_levers",
           "lever_savings", "INCOME"]
