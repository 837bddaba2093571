"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is an aggregate and a join, so a hub of any degree is pre-aggregated and its join may be split. Each step is
written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.rendezvous import shared_folder


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    ends = F.array(F.col("v"), F.col("u"))
    return down.select(F.explode(ends).alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v), both long: the component is its smallest node. Loops and repeated
    edges change nothing; nodes that only have loops are left out, as are edges with a null end."""
    shared_folder(edges.sparkSession)
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct()
    before = None
    while True:
        edges = _small_star(_large_star(edges)).checkpoint()
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
