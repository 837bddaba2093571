"""A Merkle manifest of a dataset: digests of rows, of runs of rows, of groups and of the whole, with proofs of every row.

Method: every node is labelled with the interval of leaf ranks that it covers. Leaves of a group (a language) are ranked by id; level after
level, the nodes of one bucket (interval start divided by fanout**level) become one node with the hull of their intervals, until one is
left for each group. These roots of the groups, in order of the group, are the leaves of a tree of the same kind above. On the way down a
node is joined to its ancestor by level bucket and containment of its interval, and its siblings are the ancestor's interval without its
own: what lies before it is the left part of the proof's step, what lies behind it the right part.

Each level is a table of the manifest, written to its folder, and holds 1/fanout of the rows of the level below; no task sees more of a
group than the rows of its bucket. All of it are built-in functions.

Defined results: a null field is ``-`` in its leaf, all others are their UTF-8 byte count, ``:`` and the value; null groups form one group,
the first; rows without an id stand before the others of their group; rows of equal id are ordered by their digest, so that equal rows
give equal leaves and proofs of their own place; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.ranks import ranked
from tallyflow.llm.rendezvous import shared_folder

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TRAIL = "array<struct<left:string,right:string>>"


def leaf_digest(*fields: Column) -> Column:
    """sha256 of fields framed by their lengths, so that no two different rows have the same input."""
    framed = []
    for field in fields:
        text = field.cast("string")
        framed.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*framed), 256)


def _group_key(group: Column) -> Column:
    """Texts in the order of the groups, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


@dataclass
class Manifest:
    """Where a manifest lies. ``depth`` levels stand above the leaves of the largest group, ``top_depth`` above the groups' roots."""

    path: str
    depth: int
    top_depth: int
    fanout: int = FANOUT

    def leaves(self, spark: SparkSession) -> DataFrame:
        """(tree, doc_id, digest, lo, hi, size) and the columns given to be kept."""
        return spark.read.parquet(f"{self.path}/leaves")

    def nodes(self, spark: SparkSession, level: int, top: bool = False) -> DataFrame:
        """(tree, size, lo, hi, digest, kids) of one level from 1 on; below the groups' roots or ``top``."""
        return spark.read.parquet(f"{self.path}/{'top' if top else 'nodes'}/level={level}")


def _n_nodes(level: int, fanout: int) -> Column:
    return F.ceil(F.col("size") / F.lit(fanout**level))


def _is_root(level: int, fanout: int) -> Column:
    alone = _n_nodes(level, fanout) == 1
    return alone & (_n_nodes(level - 1, fanout) > 1) if level else alone


def _depth(size: int, fanout: int) -> int:
    level = 0
    while -(-size // fanout**level) > 1:
        level += 1
    return level


def _bucket(level: int, fanout: int, lo: str = "lo") -> Column:
    return F.floor(F.col(lo) / F.lit(fanout**level))


def _grow(leaves: DataFrame, folder: str, depth: int, fanout: int) -> None:
    """Write the levels 1 to ``depth`` above ``leaves``."""
    below = leaves
    for level in range(1, depth + 1):
        family = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        runs = below.where(_n_nodes(level - 1, fanout) > 1).groupBy("tree", "size", _bucket(level, fanout).alias("bucket")).agg(family.alias("kids"))
        digest = F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), 256)
        nodes = runs.select("tree", "size", F.array_min(F.col("kids.lo")).alias("lo"), F.array_max(F.col("kids.hi")).alias("hi"), digest.alias("digest"), "kids")
        nodes.write.parquet(f"{folder}/level={level}")
        below = leaves.sparkSession.read.parquet(f"{folder}/level={level}")


def build_manifest(docs: DataFrame, keep: tuple[str, ...] = (), fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", fanout: int = FANOUT, path: str | None = None) -> Manifest:
    """Write the manifest of ``docs`` to ``path`` (by default a new folder of the shared one). Columns in ``keep`` stay beside the leaves;
    names that the manifest uses itself (tree, doc_id, digest, lo, hi, size) can't be kept."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    digests = docs.select(_group_key(F.col(group_col)).alias("tree"), F.col(id_col).alias("doc_id"), leaf_digest(*map(F.col, fields)).alias("digest"), *keep)
    digests.write.parquet(f"{path}/digests")  # texts are read and hashed once
    digests = spark.read.parquet(f"{path}/digests")
    n_rows, n_largest = digests.groupBy("tree").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    leaves = ranked(digests, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")], "lo", "size", n_rows).withColumn("hi", F.col("lo"))
    leaves.write.parquet(f"{path}/leaves")
    depth = _depth(n_largest, fanout)
    manifest = Manifest(path, depth, 0, fanout)
    _grow(manifest.leaves(spark), f"{path}/nodes", depth, fanout)

    roots = _roots(spark, manifest)
    n_trees = roots.count()
    top = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), "tree", [F.col("group")], "lo", "size", n_trees)
    top.withColumn("hi", F.col("lo")).write.parquet(f"{path}/groups")
    manifest.top_depth = _depth(n_trees, fanout)
    _grow(spark.read.parquet(f"{path}/groups"), f"{path}/top", manifest.top_depth, fanout)
    return manifest


def _roots(spark: SparkSession, manifest: Manifest) -> DataFrame:
    out = manifest.leaves(spark).where(_is_root(0, manifest.fanout)).select("tree", "digest")
    for level in range(1, manifest.depth + 1):
        out = out.union(manifest.nodes(spark, level).where(_is_root(level, manifest.fanout)).select("tree", "digest"))
    return out


def _siblings(family: str) -> Column:
    """Digests of the family before and behind the interval [lo, hi]."""
    joined = lambda part: F.array_join(F.transform(part, lambda k: k["digest"]), "")
    left = F.filter(family, lambda k: k["hi"] < F.col("lo"))
    right = F.filter(family, lambda k: k["lo"] > F.col("hi"))
    return F.struct(joined(left).alias("left"), joined(right).alias("right"))


def _descend(levels: list[DataFrame], start: DataFrame, fanout: int) -> DataFrame:
    """The rows of ``levels[0]`` with their trail: a step for every level from their own up, then that of ``start`` (tree, trail, more) of
    their tree, whose other columns come along."""
    above = None
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level]
        out = nodes.where(_is_root(level, fanout)).join(start, "tree")
        if above is not None:
            # the ancestor one level up is in the same bucket of that level and its interval holds the node's
            inner = nodes.where(~_is_root(level, fanout)).withColumn("_bucket", _bucket(level + 1, fanout))
            inner = inner.join(above, ["tree", "_bucket"]).where("_lo <= lo AND hi <= _hi")
            inner = inner.withColumn("trail", F.concat(F.array(_siblings("_family")), "_trail")).drop("_bucket", "_lo", "_hi", "_family", "_trail")
            out = out.unionByName(inner)
        if level:
            named = {"lo": "_lo", "hi": "_hi", "kids": "_family", "trail": "_trail"}
            above = out.withColumn("_bucket", _bucket(level, fanout)).drop("size", "digest").withColumnsRenamed(named)
    return out


def proofs(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """Every leaf with its ``trail`` to the root: the digests to its left and right in each run, from its own run up; and with the digests of
    its group (``subroot``) and of the whole (``root``)."""
    f = manifest.fanout
    groups = spark.read.parquet(f"{manifest.path}/groups")
    top = [groups, *(manifest.nodes(spark, k, top=True) for k in range(1, manifest.top_depth + 1))]
    whole = top[-1].select("tree", F.col("digest").alias("root"), F.lit(None).cast(TRAIL).alias("trail")).withColumn("trail", F.coalesce("trail", F.array().cast(TRAIL)))
    start = _descend(top, whole, f).select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", "trail")
    levels = [manifest.leaves(spark), *(manifest.nodes(spark, k) for k in range(1, manifest.depth + 1))]
    return _descend(levels, start, f)


def proof_digest(trail: str) -> Column:
    """sha256 of all siblings of a trail, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(trail, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: str, trail: str) -> Column:
    """The root that follows from a leaf and the siblings on its trail."""
    return F.aggregate(trail, F.col(leaf), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. Texts of ASCII alone take the shorter way."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))
