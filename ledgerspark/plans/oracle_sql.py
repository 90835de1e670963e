"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code: plain GROUP BY / window / join SQL
over the driver's tables (and, where an operator is a set formula in Spark,
the brute-force form here -- e.g. a dense calendar for the autocorrelation).
"""

from __future__ import annotations

from ..sources import testdata as td


def ledger_sql(kind: str = "nation") -> str:
    return td.ledger_events_sql() if kind == "events" else td.ledger_orders_sql(kind)


def ledger_cte(kind: str = "nation") -> str:
    """ledger = canonical rows; t = rows with date and amount; b = latest date."""
    return (f"ledger AS ({ledger_sql(kind)}),\n"
            "t AS (SELECT * FROM ledger WHERE txn_date IS NOT NULL AND amount IS NOT NULL),\n"
            "b AS (SELECT account_id, max(txn_date) AS period_end FROM t GROUP BY account_id)")


SPEND = "category IS DISTINCT FROM 'Income'"
INC = "category = 'Income'"


def last_days(days: int) -> str:
    return (f"w AS (SELECT t.*, b.period_end, b.period_end - {days} AS period_start "
            f"FROM t JOIN b USING (account_id) WHERE t.txn_date >= b.period_end - {days})")


def categories_by_period(days: int, top: int | None = None) -> str:
    rank = (f", row_number() OVER (PARTITION BY account_id ORDER BY abs(s) DESC, category) AS rank"
            if top else "")
    sql = f"""
WITH {ledger_cte()}, {last_days(days)},
g AS (SELECT account_id, category, sum(amount) AS s, count(*) AS n, min(amount) AS mn,
             max(amount) AS mx FROM w WHERE {SPEND} GROUP BY account_id, category),
c AS (SELECT g.*, sum(s) OVER (PARTITION BY account_id) AS tot{rank} FROM g)
SELECT account_id, category, CAST(abs(s) AS DOUBLE) AS total_amount, n AS transaction_count,
       abs(CAST(s AS DOUBLE) / n) AS average_amount, CAST(abs(mn) AS DOUBLE) AS min_amount,
       CAST(abs(mx) AS DOUBLE) AS max_amount,
       CASE WHEN tot <> 0 THEN CAST(abs(s) AS DOUBLE) / CAST(abs(tot) AS DOUBLE) * 100 END
         AS percentage_of_spending{', rank' if top else ''}
FROM c"""
    if top:
        sql += f" WHERE rank <= {top}"
    return sql


def daily_series(days: int, kind: str = "nation") -> str:
    return f"""
WITH {ledger_cte(kind)}, {last_days(days)},
d AS (SELECT account_id, txn_date, sum(CASE WHEN {INC} THEN amount END) AS inc,
             sum(CASE WHEN {SPEND} THEN amount END) AS spd FROM w GROUP BY 1, 2),
cal AS (SELECT account_id, CAST(unnest(generate_series(period_end - {days}, period_end,
               INTERVAL 1 DAY)) AS DATE) AS txn_date FROM b),
j AS (SELECT cal.account_id, cal.txn_date, coalesce(d.inc, 0) AS inc, coalesce(d.spd, 0) AS spd
      FROM cal LEFT JOIN d USING (account_id, txn_date))
SELECT account_id, txn_date AS date, CAST(inc AS DOUBLE) AS daily_income,
       CAST(sum(inc) OVER (PARTITION BY account_id ORDER BY txn_date) AS DOUBLE) AS cumulative_income,
       CAST(abs(spd) AS DOUBLE) AS daily_spending,
       CAST(abs(sum(spd) OVER (PARTITION BY account_id ORDER BY txn_date)) AS DOUBLE) AS cumulative_spending
FROM j"""


def _period_totals(days: int) -> str:
    return f"""
SELECT account_id, min(period_start) AS start_date, min(period_end) AS end_date,
       CAST(coalesce(sum(CASE WHEN {INC} THEN amount END), 0) AS DOUBLE) AS total_income,
       CAST(abs(coalesce(sum(CASE WHEN {SPEND} THEN amount END), 0)) AS DOUBLE) AS total_spending,
       CAST(coalesce(sum(CASE WHEN {INC} THEN amount END), 0)
            - abs(coalesce(sum(CASE WHEN {SPEND} THEN amount END), 0)) AS DOUBLE) AS net_amount,
       count(CASE WHEN {INC} THEN 1 END) AS income_transactions,
       count(CASE WHEN {SPEND} THEN 1 END) AS spending_transactions"""


def series_summary(days: int) -> str:
    return (f"WITH {ledger_cte()}, {last_days(days)}\n" + _period_totals(days)
            + f", CAST({days + 1} AS BIGINT) AS data_points FROM w GROUP BY account_id")


def category_summary(days: int, kind: str = "nation") -> str:
    return (f"WITH {ledger_cte(kind)}, {last_days(days)}\n" + _period_totals(days)
            + f", CAST({days + 1} AS BIGINT) AS days_covered, "
              f"count(DISTINCT CASE WHEN {SPEND} THEN category END) AS unique_categories "
              "FROM w GROUP BY account_id")


def current_vs_prior(kind: str = "nation") -> str:
    cur = "txn_date >= period_end - 29"
    pri = "txn_date < period_end - 29"

    def s(flag, kind):
        return f"coalesce(sum(CASE WHEN {flag} AND {kind} THEN amount END), 0)"
    ci, ce = s(cur, INC), f"abs({s(cur, SPEND)})"
    pi, pe = s(pri, INC), f"abs({s(pri, SPEND)})"
    return f"""
WITH {ledger_cte(kind)}, {last_days(58)}
SELECT account_id, CAST({ci} AS DOUBLE) AS current_income, CAST({ce} AS DOUBLE) AS current_expenses,
       CAST({ci} - {ce} AS DOUBLE) AS current_net, CAST({pi} AS DOUBLE) AS prior_income,
       CAST({pe} AS DOUBLE) AS prior_expenses, CAST({pi} - {pe} AS DOUBLE) AS prior_net,
       CAST(({ci} - {ce}) - ({pi} - {pe}) AS DOUBLE) AS net_change
FROM w GROUP BY account_id"""


def category_deltas() -> str:
    return f"""
WITH {ledger_cte()}, {last_days(58)},
g AS (SELECT account_id, category,
        abs(coalesce(sum(CASE WHEN txn_date >= period_end - 29 THEN amount END), 0)) AS cur,
        abs(coalesce(sum(CASE WHEN txn_date < period_end - 29 THEN amount END), 0)) AS pri,
        count(CASE WHEN txn_date >= period_end - 29 THEN 1 END) AS n
      FROM w WHERE {SPEND} GROUP BY account_id, category)
SELECT account_id, category, CAST(cur AS DOUBLE) AS current_amount, CAST(pri AS DOUBLE) AS prior_amount,
       CAST(cur - pri AS DOUBLE) AS delta_amount FROM g WHERE n > 0"""


def top_merchants(n: int = 5, kind: str = "nation") -> str:
    return f"""
WITH {ledger_cte(kind)}, {last_days(29)},
g AS (SELECT account_id, description, count(CASE WHEN {SPEND} THEN 1 END) AS cnt,
             CAST(abs(sum(amount)) AS DOUBLE) AS total_amount
      FROM w WHERE description IS NOT NULL GROUP BY account_id, description),
r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY cnt DESC, description) AS rank
      FROM g WHERE cnt > 0)
SELECT account_id, description AS merchant, cnt AS count, total_amount, rank FROM r WHERE rank <= {n}"""


def largest_spending_day(days: int) -> str:
    return f"""
WITH s AS ({daily_series(days)}),
r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY daily_spending DESC, date) AS rn
      FROM s WHERE daily_spending > 0)
SELECT account_id, date, daily_spending AS amount FROM r WHERE rn = 1"""


def category_spend_lookup(category: str, days: int, n: int = 10) -> str:
    return f"""
WITH c AS ({categories_by_period(days, top=n)}),
a AS (SELECT DISTINCT account_id FROM ledger_all)
SELECT a.account_id, '{category}' AS category, coalesce(c.total_amount, 0.0) AS amount
FROM a LEFT JOIN c ON a.account_id = c.account_id AND c.category = '{category}'""".replace(
        "ledger_all", f"({td.ledger_orders_sql()}) x WHERE txn_date IS NOT NULL AND amount IS NOT NULL")


def share_of_total(days: int, n: int = 10) -> str:
    return f"""
WITH c AS ({categories_by_period(days, top=n)})
SELECT *, CASE WHEN sum(CAST(total_amount AS DECIMAL(28,2))) OVER (PARTITION BY account_id) <> 0 THEN
       total_amount / CAST(sum(CAST(total_amount AS DECIMAL(28,2))) OVER (PARTITION BY account_id) AS DOUBLE)
       * 100 END AS share_pct FROM c"""


# ---------------------------------------------------------------------------
# D: account summary
# ---------------------------------------------------------------------------

def account_totals(kind: str = "nation") -> str:
    return f"""
WITH {ledger_cte(kind)}
SELECT account_id, count(*) AS total_transactions,
       CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_amount,
       CAST(coalesce(sum(CASE WHEN amount > 0 THEN amount END), 0) AS DOUBLE) AS total_income,
       CAST(abs(coalesce(sum(CASE WHEN amount < 0 THEN amount END), 0)) AS DOUBLE) AS total_expenses,
       CASE WHEN count(amount) > 0 THEN CAST(sum(amount) AS DOUBLE) / count(amount) END AS average_transaction,
       CAST(max(amount) AS DOUBLE) AS largest_transaction, CAST(min(amount) AS DOUBLE) AS smallest_transaction
FROM ledger GROUP BY account_id"""


def category_breakdown() -> str:
    return f"""
WITH {ledger_cte()}
SELECT account_id, category, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_amount,
       count(*) AS transaction_count,
       CASE WHEN count(amount) > 0 THEN CAST(sum(amount) AS DOUBLE) / count(amount) END AS average_amount
FROM ledger GROUP BY account_id, category"""


def date_range() -> str:
    return f"""
WITH {ledger_cte()}
SELECT account_id, min(txn_date) AS start_date, max(txn_date) AS end_date,
       CAST(max(txn_date) - min(txn_date) AS BIGINT) AS days_covered
FROM ledger WHERE txn_date IS NOT NULL GROUP BY account_id"""


def count_by(kind: str) -> str:
    expr = "strftime(txn_date, '%Y-%m') AS month" if kind == "month" else "dayname(txn_date) AS weekday"
    return f"""
WITH {ledger_cte()}
SELECT account_id, {expr}, count(*) AS transactions
FROM ledger WHERE txn_date IS NOT NULL GROUP BY ALL"""


def _period_sums_body() -> str:
    week = ("strftime(date_trunc('week', txn_date), '%Y-%m-%d') || '/' || "
            "strftime(CAST(date_trunc('week', txn_date) AS DATE) + 6, '%Y-%m-%d')")
    return f"""
n AS (SELECT account_id, count(*) AS rows_ FROM t GROUP BY account_id),
u AS (
  SELECT t.account_id, 'daily' AS grain, strftime(txn_date, '%Y-%m-%d') AS period, category, amount
  FROM t JOIN n USING (account_id)
  UNION ALL
  SELECT t.account_id, 'weekly', {week}, category, amount FROM t JOIN n USING (account_id) WHERE rows_ > 7
  UNION ALL
  SELECT t.account_id, 'monthly', strftime(txn_date, '%Y-%m'), category, amount
  FROM t JOIN n USING (account_id) WHERE rows_ > 30),
ps AS (SELECT account_id, grain, CASE WHEN {INC} THEN 'income' ELSE 'spending' END AS kind, period,
              CAST(sum(amount) AS DOUBLE) AS amount FROM u GROUP BY ALL)"""


def period_sums() -> str:
    return f"WITH {ledger_cte()}, {_period_sums_body()} SELECT * FROM ps"


def trend() -> str:
    return f"""
WITH {ledger_cte()}, {_period_sums_body()},
gr AS (SELECT account_id, max(CASE grain WHEN 'monthly' THEN 3 WHEN 'weekly' THEN 2 ELSE 1 END) AS g
       FROM ps GROUP BY account_id),
s AS (SELECT ps.*, CAST(row_number() OVER (PARTITION BY ps.account_id, kind ORDER BY period) - 1 AS DOUBLE) AS x
      FROM ps JOIN gr ON ps.account_id = gr.account_id
       AND CASE grain WHEN 'monthly' THEN 3 WHEN 'weekly' THEN 2 ELSE 1 END = gr.g),
sl AS (SELECT account_id, grain,
         round(coalesce(regr_slope(CASE WHEN kind = 'income' THEN amount END, x), 0.0), 4) AS income_trend,
         round(coalesce(regr_slope(CASE WHEN kind = 'spending' THEN amount END, x), 0.0), 4) AS spending_trend
       FROM s GROUP BY account_id, grain)
SELECT *, CASE WHEN income_trend > 0 THEN 'increasing' WHEN income_trend < 0 THEN 'decreasing'
               ELSE 'stable' END AS income_trend_direction,
          CASE WHEN spending_trend > 0 THEN 'increasing' WHEN spending_trend < 0 THEN 'decreasing'
               ELSE 'stable' END AS spending_trend_direction
FROM sl"""


def income_vs_spending() -> str:
    return f"""
WITH {ledger_cte()}
SELECT account_id, count(CASE WHEN {INC} THEN 1 END) AS income_transactions,
       count(CASE WHEN {SPEND} THEN 1 END) AS spending_transactions,
       count(CASE WHEN {INC} THEN 1 END) / CAST(count(*) AS DOUBLE) * 100 AS income_percentage,
       count(CASE WHEN {SPEND} THEN 1 END) / CAST(count(*) AS DOUBLE) * 100 AS spending_percentage
FROM ledger GROUP BY account_id"""


def top_categories_by_count(n: int = 10) -> str:
    return f"""
WITH {ledger_cte()},
g AS (SELECT account_id, category, count(*) AS transactions FROM ledger WHERE {SPEND} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY transactions DESC, category) AS rank FROM g)
SELECT * FROM r WHERE rank <= {n}"""


def category_distribution() -> str:
    return f"""
WITH {ledger_cte()},
g AS (SELECT account_id, category, count(*) AS transactions FROM ledger GROUP BY ALL)
SELECT account_id, category, transactions,
       round(transactions / CAST(sum(transactions) OVER (PARTITION BY account_id) AS DOUBLE) * 100, 2)
         AS percentage,
       count(*) OVER (PARTITION BY account_id) AS unique_categories
FROM g"""


def confidence_stats() -> str:
    c = f"CASE WHEN {SPEND} THEN confidence END"

    def z(e):
        return f"round(CASE WHEN count({c}) = 0 THEN 0.0 ELSE {e} END, 6)"
    return f"""
WITH {ledger_cte()}
SELECT account_id, {z(f'avg({c})')} AS mean_confidence, {z(f'quantile_cont({c}, 0.5)')} AS median_confidence,
       {z(f'min({c})')} AS min_confidence, {z(f'max({c})')} AS max_confidence,
       {z(f'stddev_samp({c})')} AS std_confidence
FROM ledger GROUP BY account_id"""


def uncategorized_rate() -> str:
    u = f"{SPEND} AND category = 'Uncategorized'"
    return f"""
WITH {ledger_cte()}
SELECT account_id, count(CASE WHEN {u} THEN 1 END) AS uncategorized_count,
       CASE WHEN count(CASE WHEN {SPEND} THEN 1 END) > 0 THEN
         count(CASE WHEN {u} THEN 1 END) / CAST(count(CASE WHEN {SPEND} THEN 1 END) AS DOUBLE) * 100
       ELSE 0.0 END AS uncategorized_percentage
FROM ledger GROUP BY account_id"""


def data_quality() -> str:
    cols = ["txn_date", "description", "amount", "category", "confidence"]
    nulls = ", ".join(f"count(*) - count({c}) AS null_{c}" for c in cols)
    alln = " + ".join(f"CAST(count({c}) = 0 AS BIGINT)" for c in cols)
    return f"""
WITH {ledger_cte()},
nn AS (SELECT account_id, {nulls}, {alln} AS columns_with_all_nulls,
              'txn_date:date,description:string,amount:decimal(18,2),category:string,confidence:double'
                AS column_types FROM ledger GROUP BY account_id),
d AS (SELECT account_id, CAST(sum(k - 1) AS BIGINT) AS duplicate_rows FROM
        (SELECT account_id, count(*) AS k FROM ledger GROUP BY account_id, {', '.join(cols)}) x
      GROUP BY account_id)
SELECT * FROM nn JOIN d USING (account_id)"""


def file_profile(n: int = 5) -> str:
    return f"""
WITH {ledger_cte()},
r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY txn_date NULLS LAST,
        description NULLS LAST, amount NULLS LAST, category NULLS LAST, confidence NULLS LAST) AS sample_rank,
        count(*) OVER (PARTITION BY account_id) AS n_rows FROM ledger)
SELECT account_id, sample_rank, txn_date, description, CAST(amount AS DOUBLE) AS amount, category, n_rows,
       CAST(6 AS BIGINT) AS n_columns,
       'account_id,txn_date,description,amount,category,confidence' AS column_names
FROM r WHERE sample_rank <= {n}"""


# ---------------------------------------------------------------------------
# F: subscription features (brute force: raw-row lag, dense calendar corr)
# ---------------------------------------------------------------------------

MERCHANT = ("trim(regexp_replace(regexp_replace(upper(description), '[^A-Z0-9&+ ]', '', 'g'), "
            "'\\s+', ' ', 'g'))")


def _features_ctes(kind: str = "nation", days: int | None = None) -> str:
    recent = f"JOIN b USING (account_id) WHERE txn_date >= period_end - {days} AND" if days else "WHERE"
    return f"""{ledger_cte(kind)},
x AS (SELECT account_id, txn_date, amount, {MERCHANT} AS merchant FROM ledger {recent}
      amount <= 0 AND txn_date IS NOT NULL AND description IS NOT NULL),
gp AS (SELECT *, txn_date - lag(txn_date) OVER (PARTITION BY account_id, merchant ORDER BY txn_date) AS gap
       FROM x),
base AS (SELECT account_id, merchant, count(*) AS n, count(DISTINCT date_trunc('month', txn_date)) AS months,
           min(txn_date) AS first, max(txn_date) - min(txn_date) AS span,
           quantile_cont(gap, 0.5) AS med, stddev_samp(gap) AS sdg, avg(gap) AS mg,
           count(amount) AS na, CAST(sum(amount) AS DOUBLE) / nullif(count(amount), 0) AS am,
           stddev_samp(CAST(amount AS DOUBLE)) AS sda,
           quantile_cont(CAST(amount AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(amount AS DOUBLE), 0.75) AS q3,
           count(CASE WHEN amount < 0 THEN 1 END) AS neg
         FROM gp GROUP BY account_id, merchant),
dm AS (SELECT account_id, merchant, day(txn_date) AS dom, count(*) AS c FROM x GROUP BY ALL),
md AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id, merchant ORDER BY c DESC, dom) AS rn
                      FROM dm) WHERE rn = 1),
hits AS (SELECT DISTINCT account_id, merchant, txn_date FROM x),
cal AS (SELECT account_id, merchant, CAST(unnest(generate_series(first, first + CAST(span AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS d
        FROM base WHERE span + 1 > 30),
dense AS (SELECT cal.account_id, cal.merchant, cal.d, CASE WHEN h.txn_date IS NULL THEN 0.0 ELSE 1.0 END AS v
          FROM cal LEFT JOIN hits h ON h.account_id = cal.account_id AND h.merchant = cal.merchant
                                   AND h.txn_date = cal.d),
pairs AS (SELECT a.account_id, a.merchant, a.v AS x0, c.v AS x1 FROM dense a JOIN dense c
          ON a.account_id = c.account_id AND a.merchant = c.merchant AND c.d = a.d + 30),
-- corr() adds floats in the order rows arrive, which moves ties of the 6th decimal; integer sums don't
moments AS (SELECT account_id, merchant, count(*) AS n, sum(CAST(x0 AS BIGINT)) AS sx, sum(CAST(x1 AS BIGINT)) AS sy,
              sum(CAST(x0 * x1 AS BIGINT)) AS sxy FROM pairs GROUP BY ALL),
acr AS (SELECT account_id, merchant, n * sx - sx * sx AS v0, n * sy - sy * sy AS v1,
          CASE WHEN n * sx > sx * sx AND n * sy > sy * sy
               THEN CAST(n * sxy - sx * sy AS DOUBLE) / sqrt(CAST(n * sx - sx * sx AS DOUBLE) * CAST(n * sy - sy * sy AS DOUBLE))
          END AS r
        FROM moments),
feats AS (
SELECT b.account_id, b.merchant, b.n AS n_occurrences, b.months AS coverage_months,
  CASE WHEN b.n < 2 THEN 0.0 ELSE b.med END AS median_gap_days,
  round(CASE WHEN b.n < 2 OR b.mg = 0 THEN 1.0 WHEN b.n = 2 THEN NULL ELSE b.sdg / b.mg END, 6) AS gap_cv,
  CAST(md.dom AS BIGINT) AS day_of_month_mode, round(md.c / b.n, 6) AS dom_consistency,
  round(coalesce(b.am, 0.0), 6) AS amount_mean,
  round(CASE WHEN b.na > 1 AND abs(b.am) > 1e-9 THEN b.sda / abs(b.am) ELSE 0.0 END, 6) AS amount_cv,
  round(CASE WHEN b.na >= 4 AND abs(b.am) > 1e-9 THEN (b.q3 - b.q1) / abs(b.am) ELSE 0.0 END, 6)
    AS amount_iqr_ratio,
  round(CASE WHEN b.span + 1 <= 30 OR acr.v0 = 0 OR acr.v1 = 0 OR acr.r IS NULL THEN 0.0
             ELSE acr.r END, 6) AS autocorr_30d,
  round(b.neg / b.n, 6) AS share_negative, CAST(b.span AS BIGINT) AS span_days
FROM base b JOIN md USING (account_id, merchant) LEFT JOIN acr USING (account_id, merchant))"""


def merchant_features(kind: str = "nation") -> str:
    return f"WITH {_features_ctes(kind)} SELECT * FROM feats"


def recent_merchant_features(days: int) -> str:
    return f"WITH {_features_ctes('nation', days)} SELECT * FROM feats"


def subscription_evaluation(words, threshold: float) -> str:
    hit = " OR ".join(f"contains(merchant, '{w}')" for w in words)
    return f"""
WITH {_features_ctes()}, p AS (SELECT dom_consistency AS score, {hit} AS y FROM feats),
c AS (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n,
             count(*) FILTER (y AND score >= {threshold}) AS tp, count(*) FILTER (NOT y AND score >= {threshold}) AS fp FROM p),
w AS (SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS won
      FROM p a JOIN p b ON a.y AND NOT b.y)
SELECT round(won::DOUBLE / (p::DOUBLE * n), 9) AS auc, round(tp::DOUBLE / (tp + fp), 9) AS precision,
       round(tp::DOUBLE / p, 9) AS recall, round(2.0::DOUBLE * tp / (tp + fp + p), 9) AS f1 FROM c, w"""


def _website_ctes(source: str) -> str:
    from ..operators.websites import SUBSCRIPTION_WEBSITES, WEBSITE_ALIASES
    sites = ", ".join(f"({i}, '{k}', '{u}')" for i, (k, u) in enumerate(SUBSCRIPTION_WEBSITES))
    aliases = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, vs) in enumerate(WEBSITE_ALIASES) for v in vs)
    return f"""
sites(ord, k, u) AS (VALUES {sites}),
aliases(ord, k, v) AS (VALUES {aliases}),
mm AS (SELECT DISTINCT merchant, upper(trim(merchant)) AS name FROM {source}),
fz AS (SELECT mm.merchant, min(s.ord) AS o FROM mm, sites s
       WHERE len(list_filter(string_split(s.k, ' '), lambda kw: contains(mm.name, kw))) > 0
          OR len(list_filter(list_filter(string_split_regex(mm.name, '\\s+'), lambda w: w <> ''),
                             lambda w: contains(s.k, w))) > 0
       GROUP BY mm.merchant),
al AS (SELECT mm.merchant, min(a.ord) AS o FROM mm, aliases a WHERE contains(mm.name, a.v) GROUP BY mm.merchant),
web AS (SELECT mm.merchant,
          CASE WHEN mm.name = '' THEN NULL
               WHEN ex.u IS NOT NULL THEN ex.u
               WHEN fz.o IS NOT NULL THEN (SELECT u FROM sites WHERE ord = fz.o)
               WHEN al.o IS NOT NULL THEN (SELECT s.u FROM aliases a2 LEFT JOIN sites s ON s.k = a2.k
                                           WHERE a2.ord = al.o LIMIT 1)
          END AS website
        FROM mm LEFT JOIN sites ex ON ex.k = mm.name LEFT JOIN fz USING (merchant) LEFT JOIN al USING (merchant))"""


def subscription_labels(words) -> str:
    hit = " OR ".join(f"contains(merchant, '{w}')" for w in words)
    return (f"WITH {_features_ctes()} SELECT account_id, merchant, coalesce(median_gap_days, 0.0) AS median_gap_days, "
            "coalesce(amount_mean, 0.0) AS amount_mean, coalesce(autocorr_30d, 0.0) AS autocorr_30d, "
            f"CASE WHEN {hit} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM feats")


def subscription_totals(threshold: float) -> str:
    return f"""
WITH {_features_ctes()},
s AS (SELECT account_id, count(*) AS k, round(sum(cost), 2) AS m FROM
        (SELECT account_id,
           round(CASE WHEN coverage_months > 0 THEN abs(amount_mean) * (n_occurrences / coverage_months)
                      WHEN median_gap_days > 0 THEN abs(amount_mean) * (30.0 / median_gap_days)
                      ELSE abs(amount_mean) END, 2) AS cost
         FROM feats WHERE dom_consistency >= {threshold}) c
      GROUP BY account_id),
e AS (SELECT account_id, count(*) AS expense_transactions_analyzed FROM x GROUP BY account_id)
SELECT account_id, coalesce(s.k, 0) AS total_subscriptions, coalesce(s.m, 0.0::DOUBLE) AS total_monthly_cost,
       round(coalesce(s.m, 0.0::DOUBLE) * 12, 2) AS total_yearly_cost, expense_transactions_analyzed
FROM e LEFT JOIN s USING (account_id)"""


def confident_subscriptions(threshold: float) -> str:
    return (f"WITH {_features_ctes()} SELECT account_id, merchant, dom_consistency AS score FROM feats "
            f"WHERE dom_consistency >= {threshold}")


def validate_goals() -> str:
    return f"""
WITH {ledger_cte("customer")}, g AS ({td.requested_goals_sql()})
SELECT account_id, target_amount, months,
       CASE WHEN account_id IS NULL THEN 'account_id is required'
            WHEN target_amount IS NULL OR target_amount <= 0 THEN 'target_amount must be positive'
            WHEN months IS NULL OR months <= 0 THEN 'months must be positive'
            WHEN account_id NOT IN (SELECT account_id FROM ledger) THEN 'account not found' END AS error
FROM g"""


def subscription_costs() -> str:
    return f"""
WITH {_features_ctes()}, {_website_ctes('feats')}
SELECT f.account_id, f.merchant, f.n_occurrences, f.coverage_months, f.median_gap_days, f.amount_mean,
       round(CASE WHEN f.coverage_months > 0 THEN abs(f.amount_mean) * (f.n_occurrences / f.coverage_months)
                  WHEN f.median_gap_days > 0 THEN abs(f.amount_mean) * (30.0 / f.median_gap_days)
                  ELSE abs(f.amount_mean) END, 2) AS average_monthly_cost,
       web.website
FROM feats f JOIN web USING (merchant)"""


# ---------------------------------------------------------------------------
# G: savings goals
# ---------------------------------------------------------------------------

def _savings_ctes() -> str:
    def kw(words):
        return " OR ".join(f"contains(lower(category), '{w}')" for w in words)
    from ..operators.savings import HIGH_PRIORITY, LOW_PRIORITY, MEDIUM_PRIORITY
    return f"""{ledger_cte()}, {last_days(90).replace('w AS', 'w90 AS')},
avg3 AS (SELECT account_id,
           CAST(coalesce(sum(CASE WHEN amount > 0 THEN amount END), 0) AS DOUBLE) / 3 AS monthly_income,
           CAST(abs(coalesce(sum(CASE WHEN amount < 0 THEN amount END), 0)) AS DOUBLE) / 3 AS monthly_expenses
         FROM w90 GROUP BY account_id),
cat3 AS (SELECT account_id, category, CAST(abs(sum(amount)) AS DOUBLE) / 3 AS monthly_amount
         FROM w90 WHERE amount < 0 GROUP BY account_id, category),
catp AS (SELECT *, CASE WHEN {kw(HIGH_PRIORITY)} THEN 1 WHEN {kw(MEDIUM_PRIORITY)} THEN 2
                        WHEN {kw(LOW_PRIORITY)} THEN 3 WHEN monthly_amount > 500 THEN 2
                        WHEN monthly_amount > 200 THEN 3 ELSE 4 END AS priority
         FROM cat3 WHERE monthly_amount > 0)"""


def monthly_averages() -> str:
    return (f"WITH {_savings_ctes()} SELECT account_id, monthly_income, monthly_expenses, "
            "monthly_income - monthly_expenses AS monthly_net FROM avg3")


def category_monthly_spend() -> str:
    return f"WITH {_savings_ctes()} SELECT * FROM catp"


def _goal_walk() -> str:
    return f"""
WITH RECURSIVE {_savings_ctes()},
goals AS ({td.goals_sql()}),
g AS (SELECT goals.*, goals.target_amount / goals.months AS monthly_target,
             a.monthly_income, a.monthly_expenses, a.monthly_income - a.monthly_expenses AS net,
             a.account_id IS NOT NULL AS has
      FROM goals LEFT JOIN avg3 a USING (account_id)),
gs AS (SELECT *, CASE WHEN has THEN greatest(0.0, monthly_target - net) ELSE monthly_target END AS shortfall
       FROM g),
ord AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY priority, monthly_amount DESC, category) AS i
        FROM catp),
walk(goal_id, account_id, i, remaining, taken, category, amount, pct, priority) AS (
  SELECT goal_id, account_id, 0, CAST(shortfall AS DOUBLE), false, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE),
         CAST(NULL AS DOUBLE), CAST(NULL AS INTEGER) FROM gs WHERE has AND shortfall > 0
  UNION ALL
  SELECT w.goal_id, w.account_id, o.i,
         CASE WHEN least(CASE o.priority WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 WHEN 3 THEN 0.15 ELSE 0.1 END,
                         w.remaining / o.monthly_amount, 1.0) > 0.05
              THEN w.remaining - o.monthly_amount * least(CASE o.priority WHEN 1 THEN 0.5 WHEN 2 THEN 0.3
                         WHEN 3 THEN 0.15 ELSE 0.1 END, w.remaining / o.monthly_amount, 1.0)
              ELSE w.remaining END,
         least(CASE o.priority WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 WHEN 3 THEN 0.15 ELSE 0.1 END,
               w.remaining / o.monthly_amount, 1.0) > 0.05,
         o.category, o.monthly_amount,
         least(CASE o.priority WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 WHEN 3 THEN 0.15 ELSE 0.1 END,
               w.remaining / o.monthly_amount, 1.0), o.priority
  FROM walk w JOIN ord o ON o.account_id = w.account_id AND o.i = w.i + 1
  WHERE w.remaining > 0),
cuts AS (SELECT goal_id, account_id, category, amount AS current_monthly, amount - amount * pct AS suggested_monthly,
                amount * pct AS reduction_amount, pct * 100 AS reduction_percentage, priority,
                row_number() OVER (PARTITION BY goal_id ORDER BY i) AS cut_order
         FROM walk WHERE taken)"""


def savings_cuts() -> str:
    return (_goal_walk() + "\nSELECT goal_id, account_id, CAST(cut_order AS BIGINT) AS cut_order, category, "
            "current_monthly, suggested_monthly, reduction_amount, reduction_percentage, "
            "CAST(priority AS INTEGER) AS priority FROM cuts")


def savings_plan() -> str:
    return _goal_walk() + """,
tot AS (SELECT goal_id, list_reduce(list(reduction_amount ORDER BY cut_order), lambda a, b: a + b) AS red,
               count(*) AS n, count(CASE WHEN priority = 1 THEN 1 END) AS n1 FROM cuts GROUP BY goal_id),
r AS (SELECT gs.*, coalesce(tot.red, 0.0) AS total_suggested_savings, coalesce(tot.n, 0) AS n_cuts,
             coalesce(tot.n1, 0) AS n1,
             CASE WHEN has THEN greatest(0.0, shortfall - coalesce(tot.red, 0.0)) ELSE monthly_target END
               AS remaining_shortfall
      FROM gs LEFT JOIN tot USING (goal_id))
SELECT goal_id, account_id, target_amount, months, monthly_target,
       CASE WHEN has THEN monthly_income ELSE 0.0 END AS monthly_income,
       CASE WHEN has THEN monthly_expenses ELSE 0.0 END AS monthly_expenses,
       CASE WHEN has THEN net ELSE 0.0 END AS monthly_savings,
       coalesce(has AND net >= monthly_target, false) AS can_achieve_goal, shortfall,
       total_suggested_savings, remaining_shortfall,
       CASE WHEN NOT has THEN 1
            WHEN remaining_shortfall > 0 THEN 2
              + CASE WHEN remaining_shortfall / months > 1000 THEN 2 ELSE 0 END
              + CASE WHEN remaining_shortfall / months > 500 THEN 2 ELSE 0 END
              + CASE WHEN remaining_shortfall / months > 200 THEN 2 ELSE 0 END
            ELSE 0 END AS n_strategies,
       CAST(n_cuts AS BIGINT) AS total_categories_analyzed, CAST(n1 AS BIGINT) AS high_priority_cuts,
       remaining_shortfall <= 0 AS achievable_with_cuts
FROM r"""


def top_levers() -> str:
    return f"""
WITH {ledger_cte()}, {last_days(29)},
g AS (SELECT account_id, category, CAST(abs(sum(amount)) AS DOUBLE) AS current_spending FROM w
      WHERE {SPEND} AND NOT coalesce(contains(lower(category), 'rent'), false) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY current_spending DESC, category) AS rank FROM g)
SELECT account_id, category, current_spending, rank, current_spending * 0.2 AS suggested_reduction,
       current_spending * 0.8 AS new_spending FROM r WHERE rank <= 3"""


# ---------------------------------------------------------------------------
# H: net worth (recursive CTE month loop)
# ---------------------------------------------------------------------------

def _households_with_defaults() -> str:
    from ..operators.networth import RATE_DEFAULTS
    rates = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in RATE_DEFAULTS.items())
    return f"SELECT *, {rates} FROM ({td.households_sql()}) hs"


def _factor(rate: str) -> str:
    return f"(1.0::DOUBLE + (pow(1.0::DOUBLE + {rate} / 100.0::DOUBLE, 1.0::DOUBLE / 12.0::DOUBLE) - 1.0::DOUBLE))"


def _projection_ctes(src: str, months: int, keys: tuple[str, ...] = ("account_id",)) -> str:
    """``sim`` = unrounded balances for t = 0..months of every row of ``src``."""
    k = ", ".join(keys)
    on = " AND ".join(f"s.{x} = h.{x}" for x in keys)
    sk = ", ".join(f"s.{x}" for x in keys)
    pay = {"mort": "pay_mortgage", "cc": "pay_cc", "pers": "pay_personal", "stud": "pay_student",
           "carl": "pay_car", "od": "pay_other_debt"}

    def debt(v):
        acc = f"(x.{v} * x.f_{v})"
        return f"CASE WHEN {acc} <= 0 OR x.{pay[v]} <= 0 THEN {acc} ELSE greatest(0.0::DOUBLE, {acc} - x.{pay[v]}) END"
    return f"""
hh AS (SELECT *, {_factor('real_estate_apr')} AS f_re, {_factor('hysa_apr')} AS f_hysa,
              {_factor('retirement_apr')} AS f_inv, {_factor('cars_apr')} AS f_cars,
              {_factor('other_assets_apr')} AS f_oa, {_factor('mortgage_apr')} AS f_mort,
              {_factor('cc_apr')} AS f_cc, {_factor('personal_apr')} AS f_pers,
              {_factor('student_apr')} AS f_stud, {_factor('car_apr')} AS f_carl,
              {_factor('other_debt_apr')} AS f_od
       FROM ({src}) src),
sim({k}, t, re, chk, hysa, inv, cars, oa, mort, cc, pers, stud, carl, od) AS (
  SELECT {k}, 0, real_estate, checking, savings_hysa, retirement_invest, cars_value, other_assets,
         real_estate_loans, credit_card_debt, personal_loans, student_loans, car_loans, other_debt FROM hh
  UNION ALL
  SELECT {k}, x.t + 1, x.re * x.f_re, x.chk1 - x.mv, (x.hysa + x.contrib_hysa) * x.f_hysa,
         ((x.inv + x.contrib_retirement) + x.mv) * x.f_inv, greatest(0.0::DOUBLE, x.cars * x.f_cars),
         x.oa * x.f_oa, {debt('mort')}, {debt('cc')}, {debt('pers')}, {debt('stud')}, {debt('carl')},
         {debt('od')}
  FROM (SELECT s.*, h.* EXCLUDE ({k}), s.chk + h.contrib_checking AS chk1,
               least(h.move_checking_to_invest, greatest(0.0::DOUBLE, s.chk + h.contrib_checking)) AS mv
        FROM sim s JOIN hh h ON {on} WHERE s.t < {months}) x)"""


def _rounded_projection(keys: tuple[str, ...] = ("account_id",), start: str = "2025-01") -> str:
    k = ", ".join(keys)
    return f"""
SELECT {k}, t, strftime(DATE '{start}-01' + to_months(t), '%Y-%m') AS month,
       round(re + chk + hysa + inv + cars + oa, 2) AS assets_total,
       round(mort + cc + pers + stud + carl + od, 2) AS liabilities_total,
       round((re + chk + hysa + inv + cars + oa) - (mort + cc + pers + stud + carl + od), 2) AS net_worth,
       round(re, 2) AS real_estate, round(chk, 2) AS checking, round(hysa, 2) AS savings_hysa,
       round(inv, 2) AS retirement_invest, round(cars, 2) AS cars_value, round(oa, 2) AS other_assets,
       round(mort, 2) AS real_estate_loans, round(cc, 2) AS credit_card_debt, round(pers, 2) AS personal_loans,
       round(stud, 2) AS student_loans, round(carl, 2) AS car_loans, round(od, 2) AS other_debt
FROM sim"""


def net_worth() -> str:
    return f"""
SELECT account_id, real_estate + checking + savings_hysa + retirement_invest + cars_value + other_assets AS assets_total,
       real_estate_loans + credit_card_debt + personal_loans + student_loans + car_loans + other_debt
         AS liabilities_total,
       (real_estate + checking + savings_hysa + retirement_invest + cars_value + other_assets)
       - (real_estate_loans + credit_card_debt + personal_loans + student_loans + car_loans + other_debt)
         AS net_worth
FROM ({td.households_sql()}) h"""


def flow_summary() -> str:
    return f"""
SELECT account_id, contrib_checking + contrib_hysa + contrib_retirement AS total_contributions_monthly,
       pay_mortgage + pay_cc + pay_personal + pay_student + pay_car + pay_other_debt AS total_debt_payments_monthly,
       (contrib_checking + contrib_hysa + contrib_retirement)
       - (pay_mortgage + pay_cc + pay_personal + pay_student + pay_car + pay_other_debt) AS net_monthly_cash_flow,
       (contrib_checking + contrib_hysa + contrib_retirement) + move_checking_to_invest
         AS display_contributions_monthly
FROM ({td.households_sql()}) h"""


def projection(months: int, emit: str | None = None) -> str:
    where = f" WHERE {emit}" if emit else ""
    return (f"WITH RECURSIVE {_projection_ctes(_households_with_defaults(), months)}\n"
            f"SELECT * FROM ({_rounded_projection()}) p{where}")


HORIZON_SQL = ("CASE t WHEN 3 THEN '3m' WHEN 12 THEN '1y' WHEN 24 THEN '2y' WHEN 60 THEN '5y' "
               "WHEN 120 THEN '10y' WHEN 240 THEN '20y' WHEN 600 THEN '50y' END")


def horizons() -> str:
    return f"""
WITH RECURSIVE {_projection_ctes(_households_with_defaults(), 600)},
p AS ({_rounded_projection()}),
cur AS ({net_worth()})
SELECT p.account_id, {HORIZON_SQL} AS horizon, CAST(t AS BIGINT) AS months, p.net_worth,
       cur.net_worth AS current_net_worth, p.net_worth - cur.net_worth AS net_worth_change,
       CASE WHEN cur.net_worth <> 0 THEN (p.net_worth - cur.net_worth) / abs(cur.net_worth) * 100 ELSE 0.0 END
         AS net_worth_change_pct,
       p.assets_total, p.liabilities_total, p.real_estate, p.checking, p.savings_hysa, p.retirement_invest,
       p.cars_value, p.other_assets, p.real_estate_loans, p.credit_card_debt, p.personal_loans,
       p.student_loans, p.car_loans, p.other_debt
FROM p JOIN cur USING (account_id) WHERE t IN (3, 12, 24, 60, 120, 240, 600)"""


def _lever_savings_sql() -> str:
    return f"""
lv AS (WITH {ledger_cte('customer')}, {last_days(29)},
       g AS (SELECT account_id, category, CAST(abs(sum(amount)) AS DOUBLE) AS cs FROM w
             WHERE {SPEND} AND NOT coalesce(contains(lower(category), 'rent'), false) GROUP BY ALL),
       r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY cs DESC, category) AS rank FROM g)
       SELECT account_id, list_reduce(list(cs * 0.2 ORDER BY rank), lambda a, b: a + b) AS monthly_savings
       FROM r WHERE rank <= 3 GROUP BY account_id),
both_ AS (SELECT h.*, 'original' AS scenario, coalesce(lv.monthly_savings, 0.0) AS monthly_savings
          FROM ({_households_with_defaults()}) h LEFT JOIN lv USING (account_id)
          UNION ALL
          SELECT h.* REPLACE (h.contrib_retirement + coalesce(lv.monthly_savings, 0.0) AS contrib_retirement),
                 'optimized', coalesce(lv.monthly_savings, 0.0)
          FROM ({_households_with_defaults()}) h LEFT JOIN lv USING (account_id))"""


def optimized_projection() -> str:
    keys = ("account_id", "scenario")
    return f"""
WITH RECURSIVE {_lever_savings_sql()},
{_projection_ctes('SELECT * FROM both_', 600, keys)},
p AS ({_rounded_projection(keys)}),
wide AS (SELECT account_id, t, max(CASE WHEN scenario = 'original' THEN net_worth END) AS o,
                max(CASE WHEN scenario = 'optimized' THEN net_worth END) AS z
         FROM p WHERE t IN (3, 12, 24, 60, 120, 240, 600) GROUP BY account_id, t),
cur AS ({net_worth()}),
sav AS (SELECT account_id, monthly_savings FROM both_ WHERE scenario = 'optimized')
SELECT account_id, {HORIZON_SQL} AS horizon, CAST(t AS BIGINT) AS months, sav.monthly_savings,
       o AS original_net_worth, z AS optimized_net_worth, o - cur.net_worth AS original_change,
       z - cur.net_worth AS optimized_change, z - o AS improvement,
       CASE WHEN o <> 0 THEN (z - o) / abs(o) * 100 ELSE 0.0 END AS improvement_pct
FROM wide JOIN cur USING (account_id) JOIN sav USING (account_id)"""


def growth_stats(months: int) -> str:
    keys = ("account_id", "scenario")
    return f"""
WITH RECURSIVE {_lever_savings_sql()},
{_projection_ctes('SELECT * FROM both_', months, keys)},
p AS ({_rounded_projection(keys)}),
g AS (SELECT account_id,
        max(CASE WHEN scenario = 'original' AND t = 0 THEN net_worth END) AS c0,
        max(CASE WHEN scenario = 'original' AND t = {months} THEN net_worth END) AS c1,
        max(CASE WHEN scenario = 'optimized' AND t = 0 THEN net_worth END) AS z0,
        max(CASE WHEN scenario = 'optimized' AND t = {months} THEN net_worth END) AS z1
      FROM p GROUP BY account_id)
SELECT account_id, CAST({months} AS BIGINT) AS months, c0 AS current_net_worth, c1 AS projected_net_worth,
       c1 - c0 AS total_growth, CASE WHEN c0 <> 0 THEN (c1 - c0) / c0 * 100 ELSE 0.0 END AS growth_pct,
       z1 - z0 AS optimized_growth, z1 - c1 AS savings_improvement
FROM g"""


def downsample(months: int, step: int) -> str:
    return (f"WITH RECURSIVE {_projection_ctes(_households_with_defaults(), months)}\n"
            f"SELECT *, strftime(CAST(month || '-01' AS DATE), '%b %Y') AS label "
            f"FROM ({_rounded_projection()}) p WHERE t % {step} = 0")


# ---------------------------------------------------------------------------
# I: money-priority plan (households = customers; ledger per customer)
# ---------------------------------------------------------------------------

def _plan_ctes() -> str:
    return f"""{ledger_cte('customer')}, {last_days(90).replace('w AS', 'w90 AS')},
avg3 AS (SELECT account_id,
           CAST(coalesce(sum(CASE WHEN amount > 0 THEN amount END), 0) AS DOUBLE) / 3 AS mi,
           CAST(abs(coalesce(sum(CASE WHEN amount < 0 THEN amount END), 0)) AS DOUBLE) / 3 AS me
         FROM w90 GROUP BY account_id),
j AS (SELECT a.*, coalesce(v.mi - v.me, 0.0) AS d, coalesce(v.me, 0.0) AS me, coalesce(v.me * 6, 0.0) AS six
      FROM ({td.priority_answers_sql()}) a LEFT JOIN avg3 v USING (account_id)),
c AS (SELECT j.*, least(d * 0.8, total_debt) AS extra, minimum_payments + least(d * 0.8, total_debt) AS pay,
             greatest(0.0, six - current_emergency_fund) AS needed,
             least(d * 0.6, greatest(0.0, six - current_emergency_fund) / 12) AS ealloc_raw,
             least(match_limit, employer_match_percentage) AS req, salary / 12 AS sm FROM j),
c2 AS (SELECT c.*, CASE WHEN pay > total_debt THEN 1.0 WHEN pay <> 0 THEN total_debt / pay
                        WHEN total_debt = 0 THEN 0.0 END AS dmonths,
              CASE WHEN needed <= 0 THEN 0.0 ELSE ealloc_raw END AS ealloc,
              CASE WHEN needed <= 0 THEN 0.0 WHEN ealloc_raw > 0 THEN needed / ealloc_raw END AS emonths,
              current_contribution >= req AS rdone,
              CASE WHEN current_contribution >= req THEN 0.0 ELSE sm * ((req - current_contribution) / 100) END
                AS ralloc FROM c),
c3 AS (SELECT c2.*, ((d - pay) - ealloc) - ralloc AS rem FROM c2)"""


def priority_rows() -> str:
    return f"""
WITH {_plan_ctes()}
SELECT account_id, 1 AS priority, 'Credit Card Debt Payoff' AS name, total_debt AS current_amount,
       0.0::DOUBLE AS target_amount, pay AS monthly_allocation, dmonths AS months_to_complete,
       CASE WHEN total_debt > 0 THEN 'in_progress' ELSE 'completed' END AS status,
       4 + CASE WHEN dmonths > 12 THEN 1 ELSE 0 END AS n_recommendations FROM c3
UNION ALL
SELECT account_id, 2, 'Emergency Fund', current_emergency_fund, six, ealloc, emonths,
       CASE WHEN needed <= 0 THEN 'completed' ELSE 'in_progress' END,
       CASE WHEN needed <= 0 THEN 1 ELSE 4 END FROM c3
UNION ALL
SELECT account_id, 3, 'Retirement Match', current_contribution, req, ralloc, CASE WHEN rdone THEN 0.0 ELSE 1.0 END,
       CASE WHEN rdone THEN 'completed' ELSE 'in_progress' END, CASE WHEN rdone THEN 1 ELSE 4 END FROM c3
UNION ALL
SELECT account_id, 4, 'Investing Allocation', 0.0, rem, rem, NULL, 'in_progress',
       5 + CASE WHEN risk_tolerance >= 4 AND investment_experience >= 3 THEN 1 ELSE 0 END FROM c3"""


def priority_advice() -> str:
    def money(x):
        return f"'$' || format('{{:,.2f}}', ({x})::DOUBLE)"

    def num(x):
        return f"CAST(({x})::DOUBLE AS VARCHAR)"
    short = "sm * ((req - current_contribution) / 100)"
    full = "sm * (req / 100)"
    acct = "preferred_retirement_account"
    return f"""
WITH {_plan_ctes()},
r AS (SELECT account_id, 1 AS priority, 'Pay off ' || {money("total_debt")} || ' in credit card debt' AS description,
  list_concat(['Pay ' || {money("pay")} || ' monthly (' || {money("minimum_payments")} || ' minimum + ' || {money("extra")} || ' extra)',
    'Focus on highest APR card first (' || {num("highest_apr")} || '%)',
    'Consider balance transfer to lower APR if possible', 'Cut up cards and use cash/debit only during payoff'],
    CASE WHEN dmonths > 12 THEN ['Consider debt consolidation loan if APR is lower'] ELSE [] END) AS xs FROM c3
UNION ALL
SELECT account_id, 2, CASE WHEN needed <= 0 THEN 'Emergency fund fully funded' ELSE 'Build emergency fund to ' || {money("six")} END,
  CASE WHEN needed <= 0 THEN ['Emergency fund is fully funded! Great job!'] ELSE [
    'Save ' || {money("ealloc_raw")} || ' monthly to emergency fund', 'Keep in high-yield savings account (HYSA) for easy access',
    'Only use for true emergencies (job loss, medical, major repairs)', 'Consider 3-month target first, then build to 6 months'] END FROM c3
UNION ALL
SELECT account_id, 3, CASE WHEN rdone THEN 'Already getting full employer match' ELSE 'Get full employer match (' || {num("req")} || '%)' END,
  CASE WHEN rdone THEN ['You''re already getting the full employer match! Great job!'] ELSE [
    'Increase contribution by ' || format('{{:,.1f}}', (req - current_contribution)::DOUBLE) || '% to get full match',
    'This requires ' || {money(short)} || ' additional monthly contribution',
    'Employer will match ' || {money(full)} || ' monthly (free money!)',
    'Total monthly retirement contribution: ' || {money(full)}] END FROM c3
UNION ALL
SELECT account_id, 4, '80% retirement/SPY, 20% HYSA', list_concat([
    'Invest ' || {money("rem * 0.8::DOUBLE")} || ' monthly in retirement accounts',
    'Save ' || {money("rem * 0.2::DOUBLE")} || ' monthly in HYSA (current rate: ' || {num("hysa_rate")} || '%)',
    'Retirement split: 70% SPY/Total Market, 30% Bonds (age-appropriate)', 'HYSA for short-term goals or emergency fund overflow'],
    CASE WHEN risk_tolerance >= 4 AND investment_experience >= 3
         THEN ['Consider 10% allocation to high-risk securities (crypto, individual stocks)'] ELSE [] END,
    [CASE WHEN {acct} = '401k' THEN 'Maximize 401k contributions first, then IRA'
          WHEN {acct} = 'ira' THEN 'Focus on IRA contributions, consider Roth vs Traditional'
          ELSE 'Balance between 401k and IRA based on tax situation' END]) FROM c3)
SELECT account_id, priority, description, unnest(range(len(xs))) AS place, unnest(xs) AS advice FROM r"""


def remaining_totals() -> str:
    return f"""
WITH {ledger_cte()}, gone AS (SELECT min(account_id) AS a FROM ledger)
SELECT account_id, count(*) AS transactions, CAST(sum(amount) AS DOUBLE) AS total_amount
FROM ledger, gone WHERE account_id <> a GROUP BY account_id"""


def priority_plan() -> str:
    return f"""
WITH {_plan_ctes()}
SELECT account_id, d AS discretionary_income, six AS six_month_expenses, me AS monthly_expenses,
       ((pay + ealloc) + ralloc) + rem AS total_allocated, d - (((pay + ealloc) + ralloc) + rem) AS remaining_discretionary,
       dmonths AS debt_payoff_months, emonths AS emergency_fund_months,
       CASE WHEN rdone THEN false ELSE true END AS retirement_match_immediate
FROM c3"""


# ---------------------------------------------------------------------------
# C: normalisation, TF-IDF k-NN
# ---------------------------------------------------------------------------

def _sq(s: str) -> str:
    return s.replace("'", "''")


def norm_sql(col: str) -> str:
    from ..functions import clean as C
    t = f"upper(coalesce(CAST({col} AS VARCHAR), ''))"
    t = f"regexp_replace({t}, '\\s+', ' ', 'g')"
    for pat in (C.DESC_TERMINAL_WORDS, C.DESC_NUMBERS, C.DESC_DATES, C.DESC_STATES, C.DESC_COUNTRY,
                C.DESC_KEEP):
        t = f"regexp_replace({t}, '{_sq(pat)}', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def terms_sql(norm: str) -> str:
    """list of unigrams + bigrams; expects a subquery column ``toks`` built by toks_sql."""
    return (f"list_concat(toks, CASE WHEN len(toks) > 1 THEN list_transform(range(1, len(toks)), "
            f"lambda i: toks[i] || ' ' || toks[i + 1]) ELSE [] END)")


def toks_sql(norm: str) -> str:
    from ..operators.categorize import english_stop_words
    stop = ", ".join(f"'{_sq(w)}'" for w in english_stop_words())
    return (f"list_filter(regexp_extract_all(lower({norm}), '\\b\\w\\w+\\b'), "
            f"lambda t: NOT list_contains([{stop}], t))")


def _knn_ctes(queries_sql: str, k: int, threshold: float, max_features: int = 30000) -> str:
    """``scored(description, category, confidence)`` for the raw texts of queries_sql."""
    return f"""
train AS (SELECT norm, label, count(*) AS n FROM (
            SELECT {norm_sql('description')} AS norm,
                   CASE WHEN CAST(category AS VARCHAR) IN ('Other', 'Uncategorized') THEN 'Uncategorized'
                        ELSE CAST(category AS VARCHAR) END AS label
            FROM ({td.category_training_sql()}) tr WHERE description IS NOT NULL AND category IS NOT NULL) x
          GROUP BY ALL),
ttok AS (SELECT norm, label, n, {toks_sql('norm')} AS toks FROM train),
tc AS (SELECT norm, label, n, term, count(*) AS tf FROM
         (SELECT norm, label, n, unnest({terms_sql('norm')}) AS term FROM ttok) x GROUP BY ALL),
stats AS (SELECT term, sum(tf * n) AS freq, sum(n) AS df FROM tc GROUP BY term),
vocab AS (SELECT term, ln(CAST(1 + (SELECT sum(n) FROM train) AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1.0 AS idf
          FROM (SELECT * FROM stats ORDER BY freq DESC, term LIMIT {max_features}) v),
post AS (SELECT norm, label, n, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY norm, label)) AS w
         FROM (SELECT tc.*, tf * idf AS raw FROM tc JOIN vocab USING (term)) x),
qd AS (SELECT DISTINCT description, {norm_sql('description')} AS norm FROM ({queries_sql}) q),
qtok AS (SELECT DISTINCT norm, {toks_sql('norm')} AS toks FROM qd),
qtc AS (SELECT norm, term, count(*) AS tf FROM (SELECT norm, unnest({terms_sql('norm')}) AS term FROM qtok) x
        GROUP BY ALL),
qv AS (SELECT norm AS qnorm, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY norm)) AS wq
       FROM (SELECT qtc.*, tf * idf AS raw FROM qtc JOIN vocab USING (term)) x),
pairs AS (SELECT qnorm, norm, label, n, round(sum(wq * w), 12) AS sim FROM qv JOIN post USING (term)
          GROUP BY qnorm, norm, label, n),
every AS (SELECT qnorm, train.norm, train.label, train.n, coalesce(sim, 0.0) AS sim
          FROM (SELECT DISTINCT norm AS qnorm FROM qd) qs CROSS JOIN train LEFT JOIN pairs USING (qnorm, norm, label)),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qnorm ORDER BY sim DESC, label, norm) AS pos
                      FROM every) x WHERE pos <= {k}),
wt AS (SELECT *, least(n, {k} - coalesce(sum(n) OVER (PARTITION BY qnorm ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS weight FROM nb),
vt AS (SELECT qnorm, label, sum(weight) AS votes, sum(weight * sim) AS s, min(pos) AS first
       FROM wt WHERE weight > 0 GROUP BY qnorm, label),
win AS (SELECT qnorm, label, round(s / votes, 6) AS conf FROM
          (SELECT *, row_number() OVER (PARTITION BY qnorm ORDER BY votes DESC, s DESC, first) AS r FROM vt) x
        WHERE r = 1),
scored AS (SELECT qd.description,
             CASE WHEN qd.description = 'AT&T' THEN 'Utilities'
                  WHEN win.conf IS NULL THEN 'Uncategorized'
                  WHEN win.conf < {threshold} THEN 'Uncategorized' ELSE win.label END AS category,
             CASE WHEN qd.description = 'AT&T' THEN 1.0 ELSE coalesce(win.conf, 0.0) END AS confidence
           FROM qd LEFT JOIN win ON win.qnorm = qd.norm)"""


def category_vocabulary(max_features: int = 30000) -> str:
    return (f"WITH {_knn_ctes('SELECT NULL AS description', 5, 0.35, max_features)} "
            "SELECT term, round(idf, 12) AS idf FROM vocab")


def knn_predictions(k: int = 7, threshold: float = 0.25) -> str:
    q = f"SELECT DISTINCT description FROM ({td.ledger_orders_sql()}) l"
    return f"WITH {_knn_ctes(q, k, threshold)} SELECT description, category, confidence FROM scored"


def categorized_summary(k: int = 5, threshold: float = 0.35) -> str:
    q = (f"SELECT coalesce(description, '') AS description FROM ({td.ledger_orders_sql()}) l "
         "WHERE amount <= 0")
    return f"""
WITH {ledger_cte()}, {_knn_ctes(q, k, threshold)},
c AS (SELECT l.account_id, l.amount,
        CASE WHEN l.amount IS NULL THEN 'Uncategorized' WHEN l.amount > 0 THEN 'Income' ELSE s.category END
          AS category,
        CASE WHEN l.amount IS NULL THEN 0.0 WHEN l.amount > 0 THEN 1.0 ELSE s.confidence END AS confidence
      FROM ledger l LEFT JOIN scored s ON s.description = coalesce(l.description, ''))
SELECT account_id, category, count(*) AS transactions, CAST(sum(amount) AS DOUBLE) AS total_amount,
       round(avg(confidence), 6) AS mean_confidence
FROM c GROUP BY account_id, category"""


# ---------------------------------------------------------------------------
# Insight facts and card validation
# ---------------------------------------------------------------------------

def _facts_ctes() -> str:
    return f"""
cash AS ({current_vs_prior()}),
deltas AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(delta_amount) DESC, category) AS rank
           FROM ({category_deltas()}) d),
merch AS ({top_merchants(5)})"""


def insight_fact_rows() -> str:
    return f"""
WITH {_facts_ctes()}
SELECT account_id, 'cashflow' AS section, CAST(0 AS BIGINT) AS rank, CAST(NULL AS VARCHAR) AS name,
       current_income AS value_1, current_expenses AS value_2, prior_net AS value_3 FROM cash
UNION ALL
SELECT account_id, 'category_delta', rank, category, current_amount, prior_amount, delta_amount
FROM deltas WHERE rank <= 6
UNION ALL
SELECT account_id, 'merchant', rank, merchant, CAST(count AS DOUBLE), total_amount, NULL FROM merch"""


def _card_ctes() -> str:
    kinds = ", ".join(f"'{k}'" for k in ["cashflow", "category_trend", "subscription", "anomaly",
                                          "merchant", "runway", "action"])
    num = "('BIGINT', 'UBIGINT', 'DOUBLE')"

    def t(path):
        return f"json_type(c, '{path}')"
    card_ok = (f"json_type(c) = 'OBJECT' AND {t('$.kind')} = 'VARCHAR' "
               f"AND json_extract_string(c, '$.kind') IN ({kinds}) "
               f"AND {t('$.title')} = 'VARCHAR' AND length(json_extract_string(c, '$.title')) <= 120 "
               f"AND {t('$.summary')} = 'VARCHAR' AND length(json_extract_string(c, '$.summary')) <= 280 "
               f"AND {t('$.period')} = 'VARCHAR' AND length(json_extract_string(c, '$.period')) <= 40 "
               f"AND {t('$.metrics')} = 'OBJECT' "
               f"AND ({t('$.impact')} IS NULL OR {t('$.impact')} IN {num} OR {t('$.impact')} = 'NULL') "
               f"AND ({t('$.cta')} IS NULL OR {t('$.cta')} IN ('OBJECT', 'NULL'))")
    return f"""{_facts_ctes()},
dl AS (SELECT account_id, list(json_object('kind', 'category_trend', 'title', category || ' spending',
               'summary', 'Change of ' || format('{{:,.2f}}', delta_amount), 'impact', delta_amount, 'period', 'Last 30d',
               'metrics', json_object('current_amount', current_amount, 'prior_amount', prior_amount))
               ORDER BY rank) AS cards FROM deltas WHERE rank <= 6 GROUP BY account_id),
ml AS (SELECT account_id, list(json_object('kind', 'merchant', 'title', merchant, 'summary', count || ' purchases',
               'impact', total_amount, 'period', 'Last 30d', 'metrics', json_object('count', count))
               ORDER BY rank) AS cards FROM merch GROUP BY account_id),
facts AS (SELECT 'facts' AS source, 'generator' AS role, cash.account_id AS source_id,
            CAST(json_object('cards', list_concat(
              [json_object('kind', 'cashflow', 'title', 'Cash flow', 'summary',
                           'Income ' || format('{{:,.2f}}', current_income) || ', expenses ' || format('{{:,.2f}}', current_expenses),
                           'impact', current_net,
                           'period', 'Last 30d', 'metrics', json_object('income', current_income))],
              coalesce(dl.cards, []), coalesce(ml.cards, []))) AS VARCHAR) AS payload
          FROM cash LEFT JOIN dl USING (account_id) LEFT JOIN ml USING (account_id)),
conv AS (SELECT 'conversation' AS source, role, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS source_id,
                text AS payload FROM conversations),
p AS (SELECT * FROM facts UNION ALL SELECT * FROM conv),
v AS (SELECT source, role, source_id, payload,
        CASE WHEN NOT coalesce(json_valid(payload), false) THEN false
             WHEN json_type(payload) <> 'OBJECT' THEN false
             ELSE coalesce(list_sort(list_distinct(json_keys(payload))) = ['cards']
                           AND json_type(payload, '$.cards') = 'ARRAY', false) END AS top_ok
      FROM p),
v2 AS (SELECT source, role, source_id, payload, top_ok,
         CASE WHEN top_ok THEN coalesce(list_bool_and(list_transform(json_extract(payload, '$.cards[*]'),
                   lambda c: coalesce({card_ok}, false))), true) ELSE false END AS valid,
         CASE WHEN top_ok THEN json_array_length(payload, '$.cards') ELSE 0 END AS n
       FROM v)
"""


def validate_cards() -> str:
    return (f"WITH {_card_ctes()} SELECT source, role, source_id, valid, "
            "CASE WHEN valid THEN CAST(n AS INTEGER) ELSE 0 END AS n_cards FROM v2")


def card_rows() -> str:
    return f"""WITH {_card_ctes()},
c AS (SELECT source, role, source_id, unnest(json_extract(payload, '$.cards[*]')) AS c, unnest(range(CAST(n AS BIGINT))) AS place FROM v2 WHERE valid)
SELECT source, role, source_id, CAST(place AS BIGINT) AS place, json_extract_string(c, '$.kind') AS kind,
       json_extract_string(c, '$.title') AS title, json_extract_string(c, '$.summary') AS summary,
       json_extract_string(c, '$.period') AS period, round(CAST(json_extract(c, '$.impact') AS DOUBLE), 2) AS impact FROM c"""


def events_json() -> str:
    return """
WITH e AS (SELECT event_id, replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') AS ts, value,
                  CASE WHEN event_id % 3 = 2 THEN value END AS ratio FROM events)
SELECT event_id, ts, ratio, '[' || coalesce(CAST(value AS VARCHAR), 'null') || ',' || coalesce(CAST(ratio AS VARCHAR), 'null') || ']' AS both,
       ts AS at_ts, ratio AS at_ratio FROM e"""


def savings_strategies() -> str:
    from ..operators import savings as G

    def texts(xs):
        return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    return f"""
WITH p AS ({savings_plan()}),
s AS (SELECT goal_id, CASE WHEN remaining_shortfall > 0 THEN list_concat(
        CASE WHEN remaining_shortfall / months > 1000 THEN {texts(G.STRATEGIES_OVER_1000)} ELSE [] END,
        CASE WHEN remaining_shortfall / months > 500 THEN {texts(G.STRATEGIES_OVER_500)} ELSE [] END,
        CASE WHEN remaining_shortfall / months > 200 THEN {texts(G.STRATEGIES_OVER_200)} ELSE [] END,
        {texts(G.STRATEGIES_ALWAYS)}) ELSE [] END AS xs FROM p)
SELECT goal_id, unnest(range(len(xs))) AS place, unnest(xs) AS strategy FROM s"""


# ---------------------------------------------------------------------------
# files
# ---------------------------------------------------------------------------

def _uploads_cte() -> str:
    """u(account_id, form, txn_date, description, amount): the ledger and its uploads' forms."""
    return f"{ledger_cte()}, u AS (SELECT *, CAST(account_id AS INTEGER) % 6 AS form FROM ledger)"


def upload_status() -> str:
    return f"""
WITH {_uploads_cte()},
n AS (SELECT account_id, form, count(*) + (form = 2)::INT AS rows FROM u GROUP BY account_id, form),
x AS (SELECT CAST(account_id AS VARCHAR) AS upload, form, rows FROM n
      UNION ALL SELECT 'copy-' || account_id, form, rows FROM n WHERE form = 0)
SELECT upload, CASE WHEN form IN (3, 4) THEN 'unparsable CSV' WHEN form = 5 THEN 'not a CSV file' ELSE 'accepted' END AS status,
       CASE WHEN form < 3 THEN CAST(rows AS BIGINT) END AS rows, CASE WHEN form < 3 THEN CAST(3 AS BIGINT) END AS columns
FROM x"""


def upload_catalog() -> str:
    return f"""
WITH {_uploads_cte()},
n AS (SELECT account_id, form, count(*) + (form IN (2, 3, 4))::INT AS rows FROM u WHERE form < 5 GROUP BY account_id, form)
SELECT 'csv' AS kind, CAST(sum(1 + (form = 0)::INT) AS BIGINT) AS files, CAST(sum(rows * (1 + (form = 0)::INT)) AS BIGINT) AS rows FROM n"""


def upload_duplicates() -> str:
    return f"""
WITH {_uploads_cte()}
SELECT CAST(account_id AS VARCHAR) AS upload, CAST(1 + (form = 0)::INT AS BIGINT) AS files, CAST((form = 0)::INT AS BIGINT) AS duplicates
FROM u GROUP BY account_id, form"""


def ingested_totals() -> str:
    return f"""
WITH {_uploads_cte()},
x AS (SELECT CAST(account_id AS VARCHAR) AS account_id, amount, txn_date,
             CASE WHEN form = 1 THEN 2 * length(description) + 6 ELSE length(description) END AS letters
      FROM u WHERE form < 3
      UNION ALL SELECT DISTINCT CAST(account_id AS VARCHAR), NULL, DATE '2024-01-01', 5 FROM u WHERE form = 2)
SELECT account_id, count(*) AS transactions, CAST(sum(amount) AS DOUBLE) AS total_amount,
       CAST(sum(letters) AS BIGINT) AS letters, max(txn_date) AS last_date FROM x GROUP BY account_id"""
