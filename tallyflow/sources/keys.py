"""The keys of a stored ledger: what tells a transaction from another, with a digest, by month and bucket of the digest.

A feed batch is checked against the keys instead of the ledger. Digests come first, eight bytes a row, and only of the buckets of
the months that the batch's own rows fall into; the keys themselves are compared for rows whose digest is there, and read from their
buckets alone. So a late row costs one bucket of its month, and no month is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.sources.feed import SAME
from tallyflow.sources.ledger import ledger_exists

BUCKETS = 16
KEYS = "digest long, user_id long, description string, amount decimal(18,2), ts timestamp_ntz, batch_id long, month string, bucket int"


def with_digest(rows: DataFrame) -> DataFrame:
    """Add the digest of a row's key, and the month and bucket that hold it."""
    digest = F.xxhash64(*SAME)
    return rows.withColumns({"digest": digest, "month": F.date_format("ts", "yyyy-MM"), "bucket": F.pmod(digest, F.lit(BUCKETS)).cast("int")})


def append_keys(rows: DataFrame, path: str, batch_id: int) -> None:
    """Store the keys of rows that go to the ledger. Files hold the digest's Parquet Bloom filter and are sorted by it."""
    keys = with_digest(rows.select(*SAME)).withColumn("batch_id", F.lit(batch_id).cast("long"))
    dealt = keys.hint("rebalance", "month", "bucket").sortWithinPartitions("month", "bucket", "digest")
    writer = dealt.write.mode("append").option("parquet.bloom.filter.enabled#digest", "true")
    writer.partitionBy("month", "bucket").parquet(path)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """The stored keys; an empty frame before the first append."""
    if not ledger_exists(spark, path):
        return spark.createDataFrame([], KEYS)
    return spark.read.schema(KEYS).parquet(path)


def compact_keys(spark: SparkSession, path: str, months: list[str]) -> None:
    """Write the buckets of some months anew, each as few files. Other months stay as they are."""
    stored = read_keys(spark, path).where(F.col("month").isin(months))
    rows = stored.groupBy("digest", *SAME, "month", "bucket").agg(F.min("batch_id").alias("batch_id"))
    whole = rows.select(*[c.split()[0] for c in KEYS.split(", ")]).hint("rebalance", "month", "bucket").sortWithinPartitions("month", "bucket", "digest")
    writer = whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#digest", "true")
    writer.partitionBy("month", "bucket").parquet(path)


def in_buckets(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """The keys in the buckets of months that rows fall into. The names of these come to the driver, at most BUCKETS for each month of the
    calendar, so that other partitions are not listed as input at all."""
    name = F.concat_ws("/", "month", F.col("bucket").cast("string"))
    return keys.where(name.isin([r[0] for r in rows.select(name).distinct().collect()]))


def known(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows (with digest) whose key is stored."""
    place = ["month", "bucket", "digest"]
    maybe = rows.join(in_buckets(keys, rows).select(*place).distinct(), place, "left_semi")
    stored = in_buckets(keys, maybe)
    same: Column = F.lit(True)
    for c in SAME:
        same = same & (F.col(f"r.{c}") == F.col(f"k.{c}"))
    on = same & (F.col("r.digest") == F.col("k.digest")) & (F.col("r.month") == F.col("k.month")) & (F.col("r.bucket") == F.col("k.bucket"))
    return maybe.alias("r").join(stored.alias("k"), on, "left_semi")
