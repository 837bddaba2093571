"""Streams over the test tables, run until their input is used up."""

from pyspark.sql import functions as F

from tallyflow.catalog.anomalies import spikes_sql
from tallyflow.catalog.imports import FEED, feed_rows
from tallyflow.catalog.registry import EVENTS, STRETCHED, big, dbl, micros, money, num, query, r, with_
from tallyflow.catalog.tasks import KNOWN, TASKS
from tallyflow.session import shared_path
from tallyflow.sources.star import events_as_ledger, events_as_mixed_ledger, events_as_tasks, stretched, table
from tallyflow.streaming import alerts, ingest, totals
from tallyflow.streaming.additive import write_partial


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


GAPS = f"""
SELECT user_id, txn_id, 'income_alert' AS alert, NULL AS category, {r('gap', 5)} AS value, 14.0 AS reference FROM (
  SELECT e.user_id, e.txn_id, count(*) AS n, (sum(g) / (count(*) - 1)) AS gap FROM (
    SELECT l.user_id, l.txn_id, h.ts,
           date_sub('microsecond', lag(h.ts) OVER (PARTITION BY l.user_id, l.txn_id ORDER BY h.ts, h.txn_id), h.ts) // 86400000000 AS g
    FROM numbered l JOIN numbered h ON h.user_id = l.user_id AND h.place BETWEEN l.place - 29 AND l.place AND h.txn_type = 'income'
    WHERE l.txn_type = 'income' AND l.place >= 5) e
  GROUP BY ALL) WHERE n >= 3 AND gap > 14"""


@query(spikes_sql(STRETCHED, "ts, txn_id", ["txn_id"]) + f""", numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, txn_id) AS place FROM ledger)
SELECT user_id, txn_id, 'spending_pattern' AS alert, category, {r('amount', 5)} AS value, {r('mean', 5)} AS reference
FROM spikes WHERE amount > mean + 2 * sd UNION ALL""" + GAPS)
def stream_alerts(spark, sf_dir):
    """Both kinds of alert on the mixed ledger, its month stretched to years. The whole table arrives at once, so the stream gives what the batch rules give."""
    out, checkpoint = shared_path(spark, "alerts"), shared_path(spark, "alerts-checkpoint")
    stream = events_as_mixed_ledger(stretched(_event_stream(spark, sf_dir)))
    alerts.start_alerts(stream, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("user_id", "txn_id", "alert", "category", num("value", 5), num("reference", 5))


@query(with_(EVENTS, select=f"""
SELECT user_id, category, strftime(ts, '%Y-%m') AS month, {dbl('SUM(amount)')} AS total, COUNT(*) AS n FROM ledger GROUP BY ALL"""))
def stream_month_totals(spark, sf_dir):
    out, checkpoint = shared_path(spark, "totals"), shared_path(spark, "totals-checkpoint")
    stream = totals.running_month_totals(events_as_ledger(_event_stream(spark, sf_dir)))
    keys = ["user_id", "category", "month"]
    totals.start_latest(stream, out, checkpoint, keys).awaitTermination()
    last = totals.read_latest(spark, out, keys)
    return last.select("user_id", "category", F.date_format("month", "yyyy-MM").alias("month"), money("total"), big("n"))


# What comes first goes by the event's number: by its rest of 4 an event arrives years before or after others of its month.
@query(with_(STRETCHED, select=f"""
SELECT user_id, category, strftime(ts, '%Y-%m') AS month, {dbl('SUM(amount)')} AS total, COUNT(*) AS n FROM ledger
WHERE txn_type = 'expense' GROUP BY ALL"""))
def stream_totals_any_lateness(spark, sf_dir):
    """Month totals of the stretched ledger, which arrives in four parts that each span all its years; the last part arrives twice, as after
    a failure."""
    schema = table(spark, sf_dir, "events").schema
    source, out = shared_path(spark, "late-events"), shared_path(spark, "late-totals")
    checkpoint = shared_path(spark, "late-checkpoint")
    for part in range(4):
        table(spark, sf_dir, "events").filter(F.col("event_id") % 4 == part).write.mode("append").parquet(source)
        rows = events_as_mixed_ledger(stretched(spark.readStream.schema(schema).parquet(source)))
        totals.start_month_totals(rows, out, checkpoint).awaitTermination()
    again = events_as_mixed_ledger(stretched(table(spark, sf_dir, "events").filter("event_id % 4 = 3")))
    write_partial(totals.running_month_totals(again), out, totals.MONTH_KEYS, totals.MONTH_SUMS, 3)
    last = totals.read_month_totals(spark, out)
    return last.select("user_id", "category", F.date_format("month", "yyyy-MM").alias("month"), money("total"), big("n"))


@query(with_(TASKS, select=f"""
SELECT agent_type, COUNT(*) AS task_count, {r('AVG(success::INT)')} AS success_rate FROM tasks WHERE {KNOWN} GROUP BY 1"""))
def stream_agent_performance(spark, sf_dir):
    out, checkpoint = shared_path(spark, "agents"), shared_path(spark, "agents-checkpoint")
    stream = totals.running_agent_totals(events_as_tasks(_event_stream(spark, sf_dir)))
    totals.start_latest(stream, out, checkpoint, ["agent_type"]).awaitTermination()
    last = totals.read_latest(spark, out, ["agent_type"])
    return last.select("agent_type", big("task_count"), num("success_rate"))


@query(with_(FEED, select=f"""
SELECT user_id, description, {dbl('amount')} AS amount, category, txn_type, epoch_us(ts) AS ts FROM fresh
UNION ALL SELECT user_id, description, {dbl('amount')}, category, txn_type, epoch_us(ts) FROM stored"""))
def stream_feed_import(spark, sf_dir):
    """Purchases are in the ledger before the feed is imported; importing it twice adds nothing more."""
    from tallyflow.sources.feed import normalise_feed
    from tallyflow.sources.ledger import append_ledger, read_ledger

    path = shared_path(spark, "feed-ledger")
    stored = normalise_feed(feed_rows(table(spark, sf_dir, "events"))).filter("category = 'purchase'")
    append_ledger(stored.drop("seq"), path)
    for _ in range(2):
        feed = feed_rows(_event_stream(spark, sf_dir))
        ingest.start_feed_import(feed, path, shared_path(spark, "feed-checkpoint")).awaitTermination()
    return read_ledger(spark, path).select("user_id", "description", money("amount"), "category", "txn_type", micros("ts"))


@query(with_(FEED, select=f"""
SELECT user_id, description, {dbl('amount')} AS amount, category, txn_type, epoch_us(ts) AS ts FROM fresh
UNION ALL SELECT user_id, description, {dbl('amount')}, category, txn_type, epoch_us(ts) FROM stored"""))
def stream_feed_import_by_keys(spark, sf_dir):
    """The same import checked against stored keys, in one stream of two batches that hold the same feed."""
    from tallyflow.sources.feed import normalise_feed
    from tallyflow.sources.keys import append_keys
    from tallyflow.sources.ledger import append_ledger, read_ledger

    path, keys, source = (shared_path(spark, x) for x in ("keyed-ledger", "ledger-keys", "keyed-feed"))
    events, checkpoint = table(spark, sf_dir, "events"), shared_path(spark, "keyed-checkpoint")
    stored = normalise_feed(feed_rows(events)).filter("category = 'purchase'")
    append_ledger(stored.drop("seq"), path)
    append_keys(stored, keys, -1)
    for _ in range(2):
        events.write.mode("append").parquet(source)
        feed = feed_rows(spark.readStream.schema(events.schema).parquet(source))
        ingest.start_feed_import_by_keys(feed, path, keys, checkpoint).awaitTermination()
    return read_ledger(spark, path).select("user_id", "description", money("amount"), "category", "txn_type", micros("ts"))
