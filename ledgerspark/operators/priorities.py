"""Four-step money-priority plan (I1-I6), re-aimed from a console
questionnaire to a table of answers: one row per household in, four
priority rows plus one plan-summary row out. Pure column arithmetic -- no
shuffle beyond the join to the ledger-derived discretionary income.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .savings import monthly_averages

# ---------------------------------------------------------------------------
# Allocation shares, months of expenses for the emergency
# fund, consolidation threshold, texts.
# ---------------------------------------------------------------------------
DEBT_SHARE = 0.8
EMERGENCY_SHARE = 0.6
EMERGENCY_MONTHS_TARGET = 6
EMERGENCY_SPREAD_MONTHS = 12
RETIREMENT_SPLIT = 0.8
HYSA_SPLIT = 0.2
CONSOLIDATION_MONTHS = 12


def _money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def _pystr(c: Column) -> Column:
    """Python ``str(float)`` for the whole-number and short decimal answers."""
    return c.cast("string")


def discretionary(txn: DataFrame) -> DataFrame:
    """Monthly discretionary income (net of the last 90 days / 3),
    monthly expenses and six months of expenses."""
    a = monthly_averages(txn)
    return a.select("account_id", F.col("monthly_net").alias("discretionary_income"),
                    F.col("monthly_expenses").alias("monthly_expenses"),
                    (F.col("monthly_expenses") * EMERGENCY_MONTHS_TARGET).alias("six_month_expenses"))


def _plan_columns(df: DataFrame) -> DataFrame:
    d = F.col("discretionary_income")
    debt, minimum = F.col("total_debt"), F.col("minimum_payments")

    # I2 credit-card debt
    extra = F.least(d * DEBT_SHARE, debt)
    pay = minimum + extra
    debt_months = (F.when(pay > debt, F.lit(1.0))
                    .when(pay != 0, debt / pay)
                    .when(debt == 0, F.lit(0.0)))      # 0 / 0: nothing owed, nothing to pay
    debt_recs = F.concat(
        F.array(F.concat(F.lit("Pay "), _money(pay), F.lit(" monthly ("), _money(minimum),
                         F.lit(" minimum + "), _money(extra), F.lit(" extra)")),
                F.concat(F.lit("Focus on highest APR card first ("), _pystr(F.col("highest_apr")),
                         F.lit("%)")),
                F.lit("Consider balance transfer to lower APR if possible"),
                F.lit("Cut up cards and use cash/debit only during payoff")),
        F.when(debt_months > CONSOLIDATION_MONTHS,
               F.array(F.lit("Consider debt consolidation loan if APR is lower")))
         .otherwise(F.array().cast("array<string>")))

    # I3 emergency fund
    target = F.col("six_month_expenses")
    current = F.col("current_emergency_fund")
    needed = F.greatest(F.lit(0.0), target - current)
    e_alloc_raw = F.least(d * EMERGENCY_SHARE, needed / EMERGENCY_SPREAD_MONTHS)
    e_done = needed <= 0
    e_alloc = F.when(e_done, F.lit(0.0)).otherwise(e_alloc_raw)
    e_months = (F.when(e_done, F.lit(0.0))
                 .when(e_alloc_raw > 0, needed / e_alloc_raw))        # else infinite -> NULL
    e_recs = F.when(e_done, F.array(F.lit("Emergency fund is fully funded! Great job!"))).otherwise(
        F.array(F.concat(F.lit("Save "), _money(e_alloc_raw), F.lit(" monthly to emergency fund")),
                F.lit("Keep in high-yield savings account (HYSA) for easy access"),
                F.lit("Only use for true emergencies (job loss, medical, major repairs)"),
                F.lit("Consider 3-month target first, then build to 6 months")))

    # I4 retirement match
    required = F.least(F.col("match_limit"), F.col("employer_match_percentage"))
    salary_m = F.col("salary") / 12
    monthly_required = salary_m * (required / 100)
    r_done = F.col("current_contribution") >= required
    additional = required - F.col("current_contribution")
    r_alloc = F.when(r_done, F.lit(0.0)).otherwise(salary_m * (additional / 100))
    r_months = F.when(r_done, F.lit(0.0)).otherwise(F.lit(1.0))
    r_recs = F.when(r_done, F.array(F.lit("You're already getting the full employer match! Great job!"))) \
        .otherwise(F.array(
            F.concat(F.lit("Increase contribution by "), F.format_number(additional, 1),
                     F.lit("% to get full match")),
            F.concat(F.lit("This requires "), _money(salary_m * (additional / 100)),
                     F.lit(" additional monthly contribution")),
            F.concat(F.lit("Employer will match "), _money(monthly_required), F.lit(" monthly (free money!)")),
            F.concat(F.lit("Total monthly retirement contribution: "), _money(monthly_required))))

    # I5 investing: what is left after priorities 1-3
    remaining = ((d - pay) - e_alloc) - r_alloc
    acct = F.col("preferred_retirement_account")
    i_recs = F.concat(
        F.array(F.concat(F.lit("Invest "), _money(remaining * RETIREMENT_SPLIT),
                         F.lit(" monthly in retirement accounts")),
                F.concat(F.lit("Save "), _money(remaining * HYSA_SPLIT),
                         F.lit(" monthly in HYSA (current rate: "), _pystr(F.col("hysa_rate")), F.lit("%)")),
                F.lit("Retirement split: 70% SPY/Total Market, 30% Bonds (age-appropriate)"),
                F.lit("HYSA for short-term goals or emergency fund overflow")),
        F.when((F.col("risk_tolerance") >= 4) & (F.col("investment_experience") >= 3),
               F.array(F.lit("Consider 10% allocation to high-risk securities (crypto, individual stocks)")))
         .otherwise(F.array().cast("array<string>")),
        F.array(F.when(acct == "401k", F.lit("Maximize 401k contributions first, then IRA"))
                 .when(acct == "ira", F.lit("Focus on IRA contributions, consider Roth vs Traditional"))
                 .otherwise(F.lit("Balance between 401k and IRA based on tax situation"))))

    prio_t = ("struct<priority:int,name:string,description:string,current_amount:double,"
              "target_amount:double,monthly_allocation:double,months_to_complete:double,"
              "status:string,recommendations:array<string>>")

    def prio(n, name, desc, cur, tgt, alloc, months, status, recs):
        return F.struct(F.lit(n).alias("priority"), F.lit(name).alias("name"), desc.alias("description"),
                        cur.cast("double").alias("current_amount"), tgt.cast("double").alias("target_amount"),
                        alloc.cast("double").alias("monthly_allocation"),
                        months.cast("double").alias("months_to_complete"),
                        status.alias("status"), recs.alias("recommendations"))
    priorities = F.array(
        prio(1, "Credit Card Debt Payoff",
             F.concat(F.lit("Pay off "), _money(debt), F.lit(" in credit card debt")),
             debt, F.lit(0.0), pay, debt_months,
             F.when(debt > 0, F.lit("in_progress")).otherwise(F.lit("completed")), debt_recs),
        prio(2, "Emergency Fund",
             F.when(e_done, F.lit("Emergency fund fully funded"))
              .otherwise(F.concat(F.lit("Build emergency fund to "), _money(target))),
             current, target, e_alloc, e_months,
             F.when(e_done, F.lit("completed")).otherwise(F.lit("in_progress")), e_recs),
        prio(3, "Retirement Match",
             F.when(r_done, F.lit("Already getting full employer match"))
              .otherwise(F.concat(F.lit("Get full employer match ("), _pystr(required), F.lit("%)"))),
             F.col("current_contribution"), required, r_alloc, r_months,
             F.when(r_done, F.lit("completed")).otherwise(F.lit("in_progress")), r_recs),
        prio(4, "Investing Allocation", F.lit("80% retirement/SPY, 20% HYSA"),
             F.lit(0.0), remaining, remaining, F.lit(None), F.lit("in_progress"), i_recs),
    ).cast(f"array<{prio_t}>")
    total = ((pay + e_alloc) + r_alloc) + remaining
    return df.select(
        "account_id", "discretionary_income", "six_month_expenses", "monthly_expenses",
        priorities.alias("priorities"),
        total.alias("total_allocated"), (d - total).alias("remaining_discretionary"),
        debt_months.alias("debt_payoff_months"), e_months.alias("emergency_fund_months"),
        (r_months == 1).alias("retirement_match_immediate"))


def priority_plan(answers: DataFrame, disc: DataFrame) -> DataFrame:
    """One plan row per household (answers joined to discretionary
    income; households without ledger rows count as 0 discretionary)."""
    j = (answers.join(disc, "account_id", "left")
                .fillna(0.0, subset=["discretionary_income", "monthly_expenses", "six_month_expenses"]))
    return _plan_columns(j)


def priority_rows(plan: DataFrame) -> DataFrame:
    """Table form: four rows per household."""
    return (plan.select("account_id", F.explode("priorities").alias("p"))
                .select("account_id", "p.*"))
