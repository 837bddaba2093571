"""Running totals over a stream of transactions and of finished tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyflow.functions.money import is_expense
from tallyflow.operators.tasks import routed
from tallyflow.streaming.additive import read_sums, write_partial
from tallyflow.streaming.keyed import read_keyed, write_keyed

MONTH_KEYS = ["user_id", "category", "month"]
MONTH_SUMS = ["total", "n"]


def running_month_totals(ledger: DataFrame, lateness: str | None = None) -> DataFrame:
    """Running expense totals by user, category and month; for update or complete output.

    With `lateness` (an interval such as '40 days') a month that starts more than that before the latest month
    seen is closed: its later rows are dropped and it leaves the state. Without it nothing is ever dropped. The
    watermark is on the month itself, since it only reaches a column that is grouped by as it is; it needs a
    plain timestamp, not timestamp_ntz.
    """
    month = F.date_trunc("month", F.col("ts").cast("timestamp"))
    rows = ledger.filter(is_expense()).withColumn("month", month)
    if lateness:
        rows = rows.withWatermark("month", lateness)
    return rows.groupBy("user_id", "category", "month").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))


def start_month_totals(ledger: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Expense totals by user, category and month of a stream, in a table at `path`; see `read_month_totals`.

    A row counts however late it comes, and nothing is held in a state: every batch stores its own sums, which add up when
    they are read. A batch that is run again overwrites its own sums, so it counts once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        write_partial(running_month_totals(batch), path, MONTH_KEYS, MONTH_SUMS, batch_id)

    writer = ledger.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_month_totals(spark, path: str) -> DataFrame | None:
    """(user_id, category, month, total, n) of all rows so far; None before the first batch."""
    return read_sums(spark, path, MONTH_KEYS, MONTH_SUMS)


def running_agent_totals(tasks: DataFrame) -> DataFrame:
    """Running task count and success rate by agent. Four keys: the partial aggregate leaves a row per task."""
    ok = F.count_if(F.col("success"))
    return routed(tasks).filter("valid").groupBy("agent_type").agg(
        F.count("*").alias("task_count"), (ok.cast("double") / F.count("*")).alias("success_rate")
    )


def start_latest(totals: DataFrame, path: str, checkpoint: str, keys: list[str], **trigger) -> StreamingQuery:
    """Keep the last value of every key in a table that is compacted now and then; see `read_latest`.

    What a batch wrote is overwritten when it is run again after a failure.
    """
    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: write_keyed(batch, path, keys, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_latest(spark, path: str, keys: list[str]) -> DataFrame:
    """The last written value of every key."""
    return read_keyed(spark, path, keys)
