"""Spending queries."""

from pyspark.sql import functions as F

from tallyflow.catalog.registry import EVENTS, HOUSEHOLD, STAR, big, dbl, micros, money, num, query, r, star_keys, with_
from tallyflow.operators import recent, spending
from tallyflow.sources.star import event_ledger, household_ledger, star_ledger, table


@query(with_(STAR, select=f"""
SELECT user_id, category, {dbl('SUM(amount)')} AS total FROM ledger WHERE txn_type = 'expense' GROUP BY ALL"""))
def category_totals(spark, sf_dir):
    return spending.category_totals(star_ledger(spark, sf_dir)).select("user_id", "category", money("total"))


@query(with_(STAR, select=f"""
SELECT user_id, category, {dbl('SUM(amount)')} AS total, COUNT(*) AS n,
       {r(dbl('SUM(amount)') + ' / COUNT(*)')} AS mean
FROM ledger WHERE txn_type = 'expense' GROUP BY user_id, category"""))
def category_stats(spark, sf_dir):
    out = spending.category_stats(star_ledger(spark, sf_dir))
    return out.select("user_id", "category", money("total"), big("n"), num("mean"))


@query(with_(STAR, select=f"""
SELECT user_id, txn_type, strftime(date_trunc('month', ts), '%Y-%m') AS month, {dbl('SUM(amount)')} AS total, COUNT(*) AS n
FROM ledger GROUP BY ALL"""))
def monthly_totals(spark, sf_dir):
    out = spending.monthly_totals(star_ledger(spark, sf_dir, with_category=False))
    return out.select("user_id", "txn_type", F.date_format("month", "yyyy-MM").alias("month"), money("total"), big("n"))


SUMMARY = with_(STAR, f"""users AS (SELECT DISTINCT user_id FROM ledger),
cats AS (SELECT user_id, category AS k, SUM(amount) AS total FROM ledger WHERE txn_type = 'expense' GROUP BY ALL),
mons AS (SELECT user_id, strftime(ts, '%Y-%m') AS k, SUM(amount) AS total FROM ledger WHERE txn_type = 'expense' GROUP BY ALL),
c AS (SELECT user_id, string_agg(k || '=' || CAST(total AS VARCHAR), ';' ORDER BY k) AS t, SUM(total) AS total FROM cats GROUP BY 1),
m AS (SELECT user_id, string_agg(k || '=' || CAST(total AS VARCHAR), ';' ORDER BY k) AS t, COUNT(*) AS n FROM mons GROUP BY 1)""",
    select=f"""
SELECT user_id, COALESCE(c.t, '') AS category_spending, COALESCE(m.t, '') AS monthly_trends,
       COALESCE({dbl('c.total')}, 0.0) AS total_expenses, COALESCE({r(dbl('c.total') + ' / m.n')}, 0.0) AS average_monthly
FROM users LEFT JOIN c USING (user_id) LEFT JOIN m USING (user_id)""")


@query(SUMMARY)
def spending_summary(spark, sf_dir):
    """Maps as sorted text 'key=total;...', so that they compare as values."""

    def text(name):
        pairs = F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
        return F.array_join(pairs, ";").alias(name)

    out = spending.spending_summary(star_ledger(spark, sf_dir))
    return out.select(
        "user_id", text("category_spending"), text("monthly_trends"), money("total_expenses"), num("average_monthly")
    )


TOP = """cats AS (SELECT user_id, category, SUM(amount) AS total FROM ledger WHERE txn_type = 'expense' GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, category) AS rk,
         SUM(total) OVER (PARTITION BY user_id) AS spent FROM cats),
top AS (SELECT user_id, category, total, spent, CAST(total AS DOUBLE) / CAST(spent AS DOUBLE) * 100.0 AS share FROM ranked WHERE rk = 1)"""


@query(with_(HOUSEHOLD, TOP, select=f"""
SELECT user_id, category AS top_category, {dbl('total')} AS top_total, {dbl('spent')} AS total_expenses, {r('share')} AS top_percent
FROM top WHERE share > 40"""))
def concentration(spark, sf_dir):
    out = spending.concentration(household_ledger(spark, sf_dir))
    return out.select("user_id", "top_category", money("top_total"), money("total_expenses"), num("top_percent"))


HIGH_DAYS = """daily AS (
  SELECT user_id, CAST(ts AS DATE) AS d, CAST(SUM(amount) AS DOUBLE) AS v FROM ledger WHERE txn_type = 'expense' GROUP BY ALL),
q AS (SELECT user_id, quantile_cont(v, 0.9) AS threshold, COUNT(*) AS n_days FROM daily GROUP BY 1),
high AS (SELECT user_id, any_value(threshold) AS threshold, any_value(n_days) AS n_days, COUNT(*) FILTER (v > threshold) AS n_high_days
         FROM daily JOIN q USING (user_id) GROUP BY 1)"""


@query(with_(STAR, HIGH_DAYS, select=f"SELECT user_id, {r('threshold', 4)} AS threshold, n_days, n_high_days FROM high"))
def high_spend_days(spark, sf_dir):
    out = spending.high_spending_days(star_ledger(spark, sf_dir, with_category=False))
    return out.select("user_id", num("threshold", 4), big("n_days"), big("n_high_days"))


@query(with_(EVENTS, HIGH_DAYS, select=f"SELECT user_id, {r('threshold', 4)} AS threshold, n_days, n_high_days FROM high"))
def high_spend_days_events(spark, sf_dir):
    out = spending.high_spending_days(event_ledger(spark, sf_dir))
    return out.select("user_id", num("threshold", 4), big("n_days"), big("n_high_days"))


@query(with_(HOUSEHOLD, TOP, HIGH_DAYS, select=f"""
SELECT user_id, 'concentration_risk' AS insight_type, category AS subject, {r('share')} AS value FROM top WHERE share > 40
UNION ALL
SELECT user_id, 'high_spending_days', NULL, {r('n_high_days')} FROM high WHERE n_high_days > 0"""))
def spending_insights(spark, sf_dir):
    out = spending.spending_insights(household_ledger(spark, sf_dir))
    return out.select("user_id", "insight_type", "subject", num("value"))


STAR_ORDER = "ts DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC, amount DESC"


@query(with_(STAR, f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {STAR_ORDER}) AS rank FROM ledger)""",
    select=f"""
SELECT user_id, rank, txn_type, {dbl('amount')} AS amount, epoch_us(ts) AS ts, k1 AS order_key, k2 AS line_number,
       k3 AS part_key, k4 AS supp_key FROM ranked WHERE rank <= 20"""))
def recent_topk(spark, sf_dir):
    out = recent.latest_rows(star_ledger(spark, sf_dir, with_category=False), 20)
    return out.select("user_id", big("rank"), "txn_type", money("amount"), micros("ts"), *star_keys())


@query(with_(STAR, f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {STAR_ORDER}) AS rank FROM ledger)""",
    select=f"""
SELECT user_id, COUNT(*) AS n_rows, {dbl("COALESCE(SUM(amount) FILTER (txn_type = 'income'), 0)")} AS recent_income,
       {dbl("COALESCE(SUM(amount) FILTER (txn_type = 'expense'), 0)")} AS recent_expenses,
       {dbl("SUM(CASE txn_type WHEN 'income' THEN amount ELSE -amount END)")} AS net_income
FROM ranked WHERE rank <= 20 GROUP BY 1"""))
def recent_summary(spark, sf_dir):
    out = recent.recent_summary(star_ledger(spark, sf_dir, with_category=False))
    return out.select("user_id", big("n_rows"), money("recent_income"), money("recent_expenses"), money("net_income"))


LISTING = """
SELECT event_id AS id, user_id, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount, event_type AS category,
       event_type || ' #' || event_id AS description, 'expense' AS transaction_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS position
FROM events"""


@query(LISTING)
def transaction_listing(spark, sf_dir):
    """Every user's list in API shape; position 1 is the newest."""
    return recent.api_rows(recent.newest_first(event_ledger(spark, sf_dir)))


@query(LISTING + " WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000)")
def transactions_of_user(spark, sf_dir):
    """The lists of requested users: customers with a large balance."""
    users = table(spark, sf_dir, "customer").filter("c_acctbal > 8000").select(F.col("c_custkey").alias("user_id"))
    return recent.api_rows(recent.newest_first(event_ledger(spark, sf_dir), users))
