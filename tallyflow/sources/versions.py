"""Stored insights whose sets are replaced in one step: new files first, then a commit that names them.

The table is dealt into buckets by user. A replacement writes the buckets it touches as a new version and then commits the list of which
version holds which bucket. Readers follow the last commit, so they see the set before or the set after, also when a writer breaks off
in between; what it left is never read. Of two writers that began from the same commit the second one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.session import drop_path
from tallyflow.sources.ledger import INSIGHT_BUCKETS


def _files(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _commits(spark: SparkSession, path: str) -> list[int]:
    files, there = _files(spark, f"{path}/commits")
    if not files.exists(there):
        return []
    names = [s.getPath().getName() for s in files.listStatus(there)]
    return sorted(int(n) for n in names if n.isdigit())


def committed(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """The last commit, or a given one, and the version that holds each bucket; (-1, {}) before the first."""
    numbers = _commits(spark, path)
    if version is None:
        version = numbers[-1] if numbers else -1
    if version < 0:
        return -1, {}
    files, there = _files(spark, f"{path}/commits/{version}")
    stream = files.open(there)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return version, {int(b): v for b, v in json.loads(text).items()}


def _commit(spark: SparkSession, path: str, version: int, held: dict[int, int]) -> None:
    """Name the versions that hold the buckets: a file that appears whole, under a number that nobody else has taken."""
    files, draft = _files(spark, f"{path}/commits/draft-{uuid.uuid4().hex}")
    stream = files.create(draft)
    try:
        stream.write(json.dumps(held).encode())
    finally:
        stream.close()
    _, final = _files(spark, f"{path}/commits/{version}")
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"version {version} has been committed by another writer")


def _read(spark: SparkSession, path: str, held: dict[int, int], schema) -> DataFrame | None:
    parts = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*parts) if parts else None


def read_version(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The insights of the last commit, or of a given one that has not been dropped."""
    _, held = committed(spark, path, version)
    rows = _read(spark, path, held, schema)
    return spark.createDataFrame([], schema) if rows is None else rows


def replace_at_once(insights: DataFrame, users: DataFrame | None, path: str) -> int:
    """Replace the stored insights of `users` by the given ones, or add these if `users` is None. Returns the version committed.

    Only buckets of these users, and of new insights, are written. There are at most INSIGHT_BUCKETS, so their numbers come to the driver.
    """
    spark, schema = insights.sparkSession, insights.schema
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(INSIGHT_BUCKETS)).cast("int").alias("bucket")
    before, held = committed(spark, path)
    version = before + 1
    whose = insights.select("user_id") if users is None else insights.select("user_id").union(users.select("user_id"))
    touched = {r["bucket"] for r in whose.select(bucket).distinct().collect()}
    stored = _read(spark, path, {b: v for b, v in held.items() if b in touched}, schema)
    rows = insights
    if stored is not None:
        if users is not None:
            stored = stored.join(users.select("user_id").distinct(), "user_id", "left_anti")
        rows = insights.unionByName(stored.select(*insights.columns))
    staged = f"{path}/data/version={version}"
    rows.select("*", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
    files, there = _files(spark, staged)
    written = {int(s.getPath().getName().split("=")[1]) for s in files.listStatus(there) if s.isDirectory()}
    now = {b: v for b, v in held.items() if b not in touched} | {b: version for b in written}
    _commit(spark, path, version, now)
    return version


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete commits before the last `keep`, and files that no remaining commit names. Not to be run beside a writer."""
    numbers = _commits(spark, path)
    kept = numbers[-keep:]
    named = {(b, v) for n in kept for b, v in committed(spark, path, n)[1].items()}
    for n in numbers[:-keep]:
        drop_path(spark, f"{path}/commits/{n}")
    files, there = _files(spark, f"{path}/data")
    for status in files.listStatus(there):
        v = int(status.getPath().getName().split("=")[1])
        for part in files.listStatus(status.getPath()):
            name = part.getPath().getName()
            if part.isDirectory() and (int(name.split("=")[1]), v) not in named:
                files.delete(part.getPath(), True)
