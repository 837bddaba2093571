"""Session settings and shared scratch space."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Cluster-independent settings. Core counts, memory and spark.sql.shuffle.partitions belong to the cluster:
# AQE coalesces partitions down from whatever the cluster sets.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # The keyword rules make one generated method too large for the JVM to compile, and all that shares it then
    # runs interpreted. At this limit Spark generates smaller methods for such a stage instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str = "tallyflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, as in tests, a local master takes a folder below the
    warehouse; on any other master executors would write to their own disks, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tallyflow-shared"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for tables written between jobs and for stream checkpoints."""
    return f"{shared_root(spark)}/tallyflow/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table below the shared folder that is no longer read."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files at or below a path."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(there).getLength()
