"""Outlier, spike, trend and gap queries, and the insight feed."""

from pyspark.sql import functions as F

from tallyflow.catalog.registry import (
    EVENTS, HOUSEHOLD, MIXED, STAR, big, dbl, micros, money, num, query, r, star_keys, with_,
)
from tallyflow.operators import anomaly
from tallyflow.plans import insights
from tallyflow.sources.star import event_ledger, household_ledger, mixed_event_ledger, star_ledger


@query(with_(EVENTS, """stats AS (
  SELECT user_id, category, COUNT(*) AS n_rows, CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS mean, stddev_pop(CAST(amount AS DOUBLE)) AS sd
  FROM ledger GROUP BY ALL HAVING COUNT(*) >= 3)""", select=f"""
SELECT user_id, category, txn_id, epoch_us(ts) AS ts, {dbl('amount')} AS amount, n_rows, {r('mean', 5)} AS mean, {r('sd', 5)} AS sd,
       CASE WHEN amount > mean + 4 * sd THEN 'high' ELSE 'medium' END AS severity
FROM ledger JOIN stats USING (user_id, category) WHERE amount > mean + 3 * sd"""))
def anomalies_3sd(spark, sf_dir):
    out = anomaly.category_outliers(event_ledger(spark, sf_dir))
    return out.select(
        "user_id", "category", "txn_id", micros("ts"), money("amount"), big("n_rows"), num("mean", 5), num("sd", 5),
        "severity",
    )


@query(with_(STAR, """stats AS (
  SELECT user_id, category, COUNT(*) AS n_rows, CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS mean, stddev_pop(CAST(amount AS DOUBLE)) AS sd
  FROM ledger WHERE txn_type = 'expense' GROUP BY ALL HAVING COUNT(*) >= 3)""", select=f"""
SELECT user_id, category, k1 AS order_key, k2 AS line_number, k3 AS part_key, k4 AS supp_key, {dbl('amount')} AS amount,
       n_rows, {r('sd', 3)} AS sd
FROM ledger JOIN stats USING (user_id, category) WHERE txn_type = 'expense' AND amount > mean + 2 * sd"""))
def anomalies_2sd(spark, sf_dir):
    out = anomaly.category_outliers(star_ledger(spark, sf_dir), times=2.0)
    return out.select("user_id", "category", *star_keys(), money("amount"), big("n_rows"), num("sd", 3))


TREND = """last AS (SELECT user_id, MAX(ts) AS last_ts FROM ledger WHERE txn_type = 'expense' GROUP BY 1),
near AS (
  SELECT user_id, SUM(amount) FILTER (ts >= last_ts - INTERVAL 30 DAY) AS recent_total,
         SUM(amount) FILTER (ts >= last_ts - INTERVAL 60 DAY AND ts < last_ts - INTERVAL 30 DAY) AS previous_total
  FROM ledger JOIN last USING (user_id) WHERE txn_type = 'expense' GROUP BY 1),
trend AS (
  SELECT *, CASE WHEN previous_total > 0
              THEN (CAST(recent_total AS DOUBLE) - CAST(previous_total AS DOUBLE)) / CAST(previous_total AS DOUBLE) * 100.0::DOUBLE
              ELSE 0.0 END AS change
  FROM near WHERE recent_total IS NOT NULL AND previous_total IS NOT NULL)"""


@query(with_(STAR, TREND, select=f"""
SELECT user_id, {dbl('recent_total')} AS recent_total, {dbl('previous_total')} AS previous_total, {r('change')} AS change_percent
FROM trend"""))
def spending_trend_30d(spark, sf_dir):
    out = anomaly.spending_trend(star_ledger(spark, sf_dir, with_category=False))
    return out.select("user_id", money("recent_total"), money("previous_total"), num("change_percent"))


UNUSUAL = """stats AS (
  SELECT user_id, COUNT(*) AS n, AVG(CAST(amount AS DOUBLE)) + 2 * stddev_samp(CAST(amount AS DOUBLE)) AS bar
  FROM ledger WHERE txn_type = 'expense' GROUP BY 1 HAVING COUNT(*) > 10),
odd AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, ts, {tie}) AS rk, COUNT(*) OVER (PARTITION BY user_id) AS n_unusual
  FROM ledger JOIN stats USING (user_id) WHERE txn_type = 'expense' AND amount > bar),
unusual AS (SELECT user_id, n_unusual, amount AS largest_unusual, category AS unusual_category FROM odd WHERE rk = 1)"""


@query(with_(EVENTS, UNUSUAL.format(tie="txn_id"), select=f"""
SELECT user_id, n_unusual, {dbl('largest_unusual')} AS largest_unusual, unusual_category FROM unusual"""))
def unusual_transactions(spark, sf_dir):
    out = anomaly.recent_and_unusual(event_ledger(spark, sf_dir)).filter("n_unusual > 0")
    return out.select("user_id", big("n_unusual"), money("largest_unusual"), "unusual_category")


def spikes_sql(ledger, order, keys):
    """A self join over the last 30 positions, where the query itself uses a window."""
    return with_(ledger, f"""placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS pos FROM ledger),
spikes AS (
  SELECT a.user_id, a.category, a.ts, a.amount, {', '.join('a.' + k for k in keys)}, COUNT(*) AS n_rows,
         CAST(SUM(b.amount) AS DOUBLE) / COUNT(*) AS mean, stddev_pop(CAST(b.amount AS DOUBLE)) AS sd
  FROM placed a JOIN placed b ON a.user_id = b.user_id AND a.category = b.category AND b.txn_type = 'expense'
       AND b.pos BETWEEN a.pos - 29 AND a.pos
  WHERE a.txn_type = 'expense' AND a.pos >= 5
  GROUP BY a.user_id, a.category, a.ts, a.amount, a.pos, {', '.join('a.' + k for k in keys)}
  HAVING COUNT(*) >= 3)""", select="")


@query(spikes_sql(STAR, "ts, k1, k2, k3, k4, amount", ["k1", "k2", "k3", "k4"]) + f"""
SELECT user_id, category, {dbl('amount')} AS amount, k1 AS order_key, k2 AS line_number, k3 AS part_key, k4 AS supp_key,
       n_rows, {r('mean', 3)} AS mean, {r('sd', 3)} AS sd
FROM spikes WHERE amount > mean + 2 * sd""")
def spending_spikes(spark, sf_dir):
    out = anomaly.spending_spikes(star_ledger(spark, sf_dir), times_of=star_ledger(spark, sf_dir, with_category=False))
    return out.select("user_id", "category", money("amount"), *star_keys(), big("n_rows"), num("mean", 3), num("sd", 3))


@query(spikes_sql(EVENTS, "ts, txn_id", ["txn_id"]) + f"""
SELECT user_id, category, txn_id, epoch_us(ts) AS ts, {dbl('amount')} AS amount, n_rows, {r('mean', 5)} AS mean, {r('sd', 5)} AS sd
FROM spikes WHERE amount > mean + 2 * sd""")
def spending_spikes_events(spark, sf_dir):
    out = anomaly.spending_spikes(event_ledger(spark, sf_dir))
    return out.select(
        "user_id", "category", "txn_id", micros("ts"), money("amount"), big("n_rows"), num("mean", 5), num("sd", 5)
    )


GAPS = """latest AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rk FROM ledger QUALIFY rk <= 30),
gaps AS (
  SELECT user_id, date_sub('day', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS gap FROM latest WHERE txn_type = 'income'),
mean_gaps AS (SELECT user_id, COUNT(*) AS n_incomes, AVG(gap) AS mean_gap FROM gaps GROUP BY 1 HAVING COUNT(*) >= 3)"""


@query(with_(STAR, GAPS.format(order="ts DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC, amount DESC"), select=f"""
SELECT user_id, n_incomes, {r('mean_gap', 6)} AS mean_gap_days, mean_gap > 14 AS alert FROM mean_gaps"""))
def income_gaps(spark, sf_dir):
    out = anomaly.income_gaps(star_ledger(spark, sf_dir, with_category=False))
    return out.select("user_id", big("n_incomes"), num("mean_gap_days"), "alert")


@query(with_(MIXED, GAPS.format(order="ts DESC, txn_id DESC"), select=f"""
SELECT user_id, n_incomes, {r('mean_gap', 6)} AS mean_gap_days, mean_gap > 14 AS alert FROM mean_gaps"""))
def income_gaps_events(spark, sf_dir):
    out = anomaly.income_gaps(mixed_event_ledger(spark, sf_dir))
    return out.select("user_id", big("n_incomes"), num("mean_gap_days"), "alert")


def feed_sql(ledger, tie):
    """The feed, rule by rule as a union."""
    return with_(ledger, TREND, UNUSUAL.format(tie=tie), f"""counts AS (
  SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (txn_type = 'income') AS ni, COUNT(*) FILTER (txn_type = 'expense') AS ne,
         CAST(COALESCE(SUM(amount) FILTER (txn_type = 'income'), 0) AS DOUBLE) AS income,
         CAST(COALESCE(SUM(amount) FILTER (txn_type = 'income'), 0) - COALESCE(SUM(amount) FILTER (txn_type = 'expense'), 0) AS DOUBLE) AS saved
  FROM ledger GROUP BY 1),
rates AS (SELECT *, CASE WHEN income > 0 THEN saved / income * 100.0::DOUBLE ELSE 0.0 END AS rate FROM counts),
cats AS (
  SELECT user_id, category, SUM(amount) AS total, CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS mean FROM ledger
  WHERE txn_type = 'expense' GROUP BY ALL),
shares AS (
  SELECT user_id, category, CAST(total AS DOUBLE) / CAST(SUM(total) OVER (PARTITION BY user_id) AS DOUBLE) * 100.0::DOUBLE AS share,
         row_number() OVER (PARTITION BY user_id ORDER BY total DESC, category) AS rk FROM cats),
tips AS (
  SELECT user_id, category, mean, row_number() OVER (PARTITION BY user_id ORDER BY category) AS rk FROM cats
  WHERE mean > 100 AND lower(category) IN ('shopping', 'entertainment', 'dining')),
feed AS (
  SELECT user_id, 1 AS rank, 'spending_pattern' AS insight_type, CASE WHEN share > 50 THEN 'high' ELSE 'medium' END AS priority,
         share AS value, category AS subject FROM shares WHERE rk = 1 AND share > 30
  UNION ALL SELECT user_id, 2, 'savings_alert', 'high', rate, NULL FROM rates WHERE ni > 0 AND ne > 0 AND rate < 10
  UNION ALL SELECT user_id, 2, 'savings_success', 'low', rate, NULL FROM rates WHERE ni > 0 AND ne > 0 AND rate >= 20
  UNION ALL SELECT user_id, 3, 'trend_alert', 'medium', change, NULL FROM trend WHERE abs(change) > 20
  UNION ALL SELECT user_id, 4, 'anomaly_detection', 'medium', CAST(largest_unusual AS DOUBLE), unusual_category FROM unusual
  UNION ALL SELECT user_id, 5, 'recommendation', 'low', mean, category FROM tips WHERE rk = 1),
insights AS (
  SELECT * FROM feed WHERE user_id IN (SELECT user_id FROM counts WHERE n >= 3)
  UNION ALL SELECT user_id, 0, 'welcome', 'low', NULL, NULL FROM counts WHERE n < 3)""", select="")


def _feed_columns(out):
    return out.select("user_id", big("rank"), "insight_type", "priority", num("value", 5), "subject")


FEED = f"SELECT user_id, CAST(rank AS BIGINT) AS rank, insight_type, priority, {r('value', 5)} AS value, subject FROM insights"


@query(feed_sql(HOUSEHOLD, "k1, k2, k3, k4") + FEED)
def insights_feed(spark, sf_dir):
    return _feed_columns(insights.insight_feed(household_ledger(spark, sf_dir)))


@query(feed_sql(MIXED, "txn_id") + FEED)
def insights_feed_events(spark, sf_dir):
    return _feed_columns(insights.insight_feed(mixed_event_ledger(spark, sf_dir)))


@query(feed_sql(MIXED, "txn_id") + f"""
SELECT user_id, CAST(rank AS BIGINT) AS rank, insight_type, priority, {r('value', 5)} AS value, subject FROM insights
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 200)
  AND user_id IN (SELECT c_custkey FROM customer)
UNION ALL
SELECT c_custkey, 0, 'welcome', 'low', NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def insights_if_missing(spark, sf_dir):
    """Customers are the users; those with a signup above 200 have insights already."""
    ledger = mixed_event_ledger(spark, sf_dir)
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    existing = ledger.filter("category = 'signup' AND amount > 200").select("user_id")
    return _feed_columns(insights.missing_insights(ledger, users, existing))


@query(feed_sql(MIXED, "txn_id") + """
SELECT i.user_id, CAST(rank AS BIGINT) AS rank, CASE insight_type
  WHEN 'welcome' THEN 'Add transactions to see insights about your spending, savings and financial health.'
  WHEN 'spending_pattern' THEN printf('%s takes %.1f%% of your expenses, %.2f in all.', subject, value, (SELECT CAST(total AS DOUBLE) FROM cats c WHERE c.user_id = i.user_id AND c.category = subject))
  WHEN 'savings_alert' THEN printf('You save %.1f%% of your income; aim for 20%%.', value)
  WHEN 'savings_success' THEN printf('You save %.1f%% of your income. Well done.', value)
  WHEN 'trend_alert' THEN printf('Spending changed by %+.1f%% against the 30 days before.', value)
  WHEN 'anomaly_detection' THEN printf('%d unusually large, the largest %.2f in %s.', n_unusual, value, subject)
  ELSE printf('%s averages %.2f a time; set a limit.', subject, value) END AS content
FROM insights i LEFT JOIN unusual u ON u.user_id = i.user_id""")
def insight_text(spark, sf_dir):
    """The sentences shown, with amounts and counts."""
    out = insights.insight_text(insights.insight_feed(mixed_event_ledger(spark, sf_dir)))
    return out.select("user_id", big("rank"), "content")
