"""Incremental import of a bank feed into the stored ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyflow.session import drop_path, shared_path
from tallyflow.sources.feed import SAME, new_rows, normalise_feed
from tallyflow.sources.keys import append_keys, in_buckets, known, read_keys, with_digest
from tallyflow.sources.ledger import append_ledger, ledger_exists, read_ledger


def in_months(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger's rows in the months of other rows. Months come to the driver, a few thousand at most, to prune partitions by name."""
    return ledger.where(F.col("month").isin([r["month"] for r in rows.select("month").distinct().collect()]))


def import_batch(feed: DataFrame, ledger_path: str) -> None:
    """Append the rows of one feed batch that the ledger lacks. Running it again adds nothing.

    Only the months of the batch are read from the ledger. The batch is evaluated once.
    """
    spark = feed.sparkSession
    rows = normalise_feed(feed).withColumn("month", F.date_format("ts", "yyyy-MM")).persist()
    try:
        if ledger_exists(spark, ledger_path):
            stored = in_months(read_ledger(spark, ledger_path, schema=rows.drop("seq").schema), rows)
        else:
            stored = rows.filter(F.lit(False))
        fresh = new_rows(rows, stored)
        append_ledger(fresh.drop("seq", "month"), ledger_path)
    finally:
        rows.unpersist()


def start_feed_import(feed: DataFrame, ledger_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Import a stream of feed rows. The horizon of the duplicate check is the whole ledger, not a watermark."""
    return (
        feed.writeStream.foreachBatch(lambda batch, _: import_batch(batch, ledger_path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def import_batch_by_keys(feed: DataFrame, ledger_path: str, keys_path: str, batch_id: int) -> None:
    """Append the rows of one feed batch whose keys are not stored yet; the ledger itself is not read.

    Keys are stored before rows, under the batch's number. A batch that finds keys of its own number was broken off and is run
    again: which of its rows the ledger has is then looked up in the ledger. The batch is evaluated once.
    """
    spark = feed.sparkSession
    rows = with_digest(normalise_feed(feed)).persist()
    try:
        keys = read_keys(spark, keys_path)
        if in_buckets(keys, rows).where(F.col("batch_id") == batch_id).isEmpty():
            fresh = new_rows(rows, known(rows, keys).select(*SAME))
        else:
            stored = rows.filter(F.lit(False)).drop("seq")
            if ledger_exists(spark, ledger_path):
                stored = in_months(read_ledger(spark, ledger_path, schema=rows.drop("seq", "digest", "bucket").schema), rows)
            fresh = new_rows(rows, stored)
        # written first: what reads the keys, cached or not, would be computed anew once keys are added
        path = shared_path(spark, "fresh")
        fresh.drop("seq", "month", "digest", "bucket").write.parquet(path)
        fresh = spark.read.schema(fresh.drop("seq", "month", "digest", "bucket").schema).parquet(path)
        append_keys(fresh, keys_path, batch_id)
        append_ledger(fresh, ledger_path)
        drop_path(spark, path)
    finally:
        rows.unpersist()


def start_feed_import_by_keys(feed: DataFrame, ledger_path: str, keys_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Import a stream of feed rows, checked against all keys ever stored."""
    return (
        feed.writeStream.foreachBatch(lambda batch, batch_id: import_batch_by_keys(batch, ledger_path, keys_path, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
