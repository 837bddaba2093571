"""The stored ledger and the stored insights: parquet tables, partitioned for pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

INSIGHT_BUCKETS = 256


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append rows, partitioned by calendar month.

    The rebalance hint lets AQE write files of even size: it merges small months and splits large ones.
    """
    with_month = rows.withColumn("month", F.date_format("ts", "yyyy-MM"))
    with_month.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def ledger_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything has been appended yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def read_ledger(
    spark: SparkSession,
    path: str,
    users: DataFrame | None = None,
    txn_type: str | None = None,
    months: tuple[str, str] | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    """The ledger, optionally of some users, of one type or of an inclusive range of months (partition pruning).

    With a schema no file is opened to infer one.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(path).withColumn("month", F.col("month").cast("string"))
    if months:
        rows = rows.filter(F.col("month").between(*months))
    if users is not None:
        rows = rows.join(users.select("user_id").distinct(), "user_id", "left_semi")
    if txn_type:
        rows = rows.filter(F.col("txn_type") == txn_type)
    return rows


def _bucketed(insights: DataFrame) -> DataFrame:
    return insights.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(INSIGHT_BUCKETS)).cast("int"))


def append_insights(insights: DataFrame, path: str) -> None:
    """Add a set of insights to those already stored."""
    _bucketed(insights).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def replace_insights(insights: DataFrame, users: DataFrame, path: str) -> None:
    """Delete the stored insights of `users` and store the new ones.

    Only the buckets of these users are rewritten, by dynamic partition overwrite: the old files stay until the
    new ones are committed. The buckets are at most INSIGHT_BUCKETS, hence the broadcast.
    """
    spark = insights.sparkSession
    named = _bucketed(users.select("user_id").distinct())
    buckets = named.select("bucket").distinct()
    stored = spark.read.schema(_bucketed(insights).schema).parquet(path)
    kept = stored.join(F.broadcast(buckets), "bucket", "left_semi").join(named.select("user_id"), "user_id", "left_anti")
    # A NULL row per touched bucket makes Spark overwrite it even when nothing else remains in it.
    blanks = buckets.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in insights.schema.fields], "bucket")
    rows = kept.unionByName(_bucketed(insights)).unionByName(blanks)
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket"
    ).parquet(path)


def read_insights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("user_id IS NOT NULL").drop("bucket")
