"""Ranks within groups of any size, and over whole tables, without gathering a group in one task.

Rows are dealt by range of (group, order) and sorted where they land. A row's rank is its place in its chunk plus the rows of its group in
earlier chunks; only one small row for each chunk and group is summed up for that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.rendezvous import shared_folder

CHUNK_ROWS = 1_000_000


def ranked(rows: DataFrame, group: str, order: list[Column], rank: str, size: str, n_rows: int) -> DataFrame:
    """``rows`` with their ``rank`` (from 0) within the not-null ``group`` and the group's ``size``. Rows that are equal in ``order`` stand
    in any order, fixed once. ``n_rows`` is about how many rows there are."""
    spark = rows.sparkSession
    shared_folder(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / CHUNK_ROWS))
    keys = [F.col(group), *order, F.col("_salt")]  # the salt parts rows that are equal otherwise
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_salt")
    # sampled bounds may differ when they are computed again, so places are fixed before they are counted
    dealt = dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_chunk", F.shiftright("_at", 33)).checkpoint()
    chunks = dealt.groupBy(group, "_chunk").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(group)
    earlier = own.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(group, "_chunk", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias(size))
    return dealt.join(chunks, [group, "_chunk"]).withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first")).drop("_chunk", "_at", "_first", "_before")
