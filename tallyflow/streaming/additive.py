"""Stored tables that are merged from the parts that batches wrote, and compacted now and then.

What can be merged in any order, such as sums or greatest values, is stored for each batch alone: no batch reads what was there before it,
and rows may belong to any key at any time. The layout is that of `keyed`: ``batch=n`` holds the part of batch n, ``full=n`` all parts
up to n merged. Running a batch again overwrites its own part and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.streaming.keyed import COMPACT_EVERY, _numbers, drop_needless, parts_before

Merge = Callable[[DataFrame], DataFrame]


def read_merged(spark: SparkSession, path: str, merge: Merge, before: int | None = None) -> DataFrame | None:
    """All parts merged, or those of the batches below `before`; None if there are none yet. Columns keep their type."""
    parts = parts_before(spark, path, before)
    if not parts:
        return None
    first = spark.read.parquet(parts[0][1])
    merged = merge(spark.read.schema(first.schema).parquet(*[p for _, p in parts]))
    return merged.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in first.schema.fields])


def write_part(rows: DataFrame, path: str, merge: Merge, batch_id: int, every: int = COMPACT_EVERY) -> None:
    """Store the part of a batch."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    if (batch_id + 1) % every or batch_id in _numbers(spark, path, "full"):
        return
    read_merged(spark, path, merge, batch_id + 1).write.mode("overwrite").parquet(f"{path}/full={batch_id}")
    drop_needless(spark, path, batch_id)


def _summed(keys: list[str], sums: list[str]) -> Merge:
    return lambda rows: rows.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def read_sums(spark: SparkSession, path: str, keys: list[str], sums: list[str], before: int | None = None) -> DataFrame | None:
    """The sums of every key over all batches, or over those below `before`; None if there are none yet.

    What a stored decimal can't hold raises, as it would in one sum.
    """
    return read_merged(spark, path, _summed(keys, sums), before)


def write_partial(rows: DataFrame, path: str, keys: list[str], sums: list[str], batch_id: int, every: int = COMPACT_EVERY) -> None:
    """Store the sums of a batch, a row for each of its keys."""
    write_part(rows.select(*keys, *sums), path, _summed(keys, sums), batch_id, every)
