"""A stored table of the last value of every key, written batch by batch and compacted now and then.

Batch n goes to ``batch=n``; running it again overwrites it. Every ``every`` batches the last values so far are also written whole to
``full=n``, and what two newer whole tables make needless is deleted, so what has to be read and kept stays bounded by the number of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.session import drop_path

COMPACT_EVERY = 20


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete parts of a kind."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [status.getPath() for status in files.listStatus(root)]
    done = [p.getName() for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done if n.startswith(f"{kind}="))


def parts_before(spark: SparkSession, path: str, before: int | None) -> list[tuple[int, str]]:
    """Number and path of the latest whole table and of the batches after it, of those below `before` if given."""
    below = float("inf") if before is None else before
    full = [n for n in _numbers(spark, path, "full") if n < below]
    start = full[-1] if full else -1
    parts = [(n, f"{path}/full={n}") for n in full[-1:]]
    return parts + [(n, f"{path}/batch={n}") for n in _numbers(spark, path, "batch") if start < n < below]


def read_keyed(spark: SparkSession, path: str, keys: list[str], before: int | None = None, schema=None) -> DataFrame | None:
    """The last value of every key, of the batches below `before` if given; None if there are none yet."""
    parts = parts_before(spark, path, before)
    if not parts:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    frames = [reader.parquet(p).withColumn("_n", F.lit(n)) for n, p in parts]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    values = [c for c in rows.columns if c not in (*keys, "_n")]
    last = rows.groupBy(*keys).agg(F.max(F.struct("_n", *values)).alias("_last")) if _ordered(rows, values) else None
    if last is not None:
        return last.select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])
    return rows.groupBy(*keys).agg(*[F.max_by(v, "_n").alias(v) for v in values])


def _ordered(rows: DataFrame, values: list[str]) -> bool:
    """Whether all values are flat: one struct is compared then instead of one maximum kept for each."""
    flat = {f.name for f in rows.schema.fields if not any(t in f.dataType.typeName() for t in ("array", "map", "struct", "variant"))}
    return set(values) <= flat


def write_keyed(rows: DataFrame, path: str, keys: list[str], batch_id: int, every: int = COMPACT_EVERY) -> None:
    """Store a batch of changed keys."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    if (batch_id + 1) % every or batch_id in _numbers(spark, path, "full"):
        return
    read_keyed(spark, path, keys, batch_id + 1, rows.schema).write.mode("overwrite").parquet(f"{path}/full={batch_id}")
    drop_needless(spark, path, batch_id)


def drop_needless(spark: SparkSession, path: str, batch_id: int) -> None:
    """Delete what a new whole table makes needless."""
    # a batch that is run again reads what was there before it, so the whole table before this one stays
    earlier = [n for n in _numbers(spark, path, "full") if n < batch_id]
    if earlier:
        for kind in ("full", "batch"):
            for n in _numbers(spark, path, kind):
                if n < earlier[-1] or (kind == "batch" and n == earlier[-1]):
                    drop_path(spark, f"{path}/{kind}={n}")
