"""Work on groups that may hold a large part of all rows.

One user (or category, or agent) can own a third of the ledger. Nothing here gathers such a group in one task:
aggregates are partial before their shuffle, per-group statistics are attached with a salted join, and
groups that must be put in order are cut into chunks of that order whose bounds (days, months, ranges of a value) are
arguments that don't depend on the data. There is one path for all sizes; no row is dropped or capped, and no job runs while
a plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one group that a single task of a salted join may hold. Above it the group is spread over n / SPLIT_ROWS tasks.
SPLIT_ROWS = 1_000_000


def attach_group_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: list[str],
    n: str,
    salt_by: list[str],
    split_rows: int = SPLIT_ROWS,
    how: str = "left",
) -> DataFrame:
    """Join of `stats` (one row per key, with its row count in column `n`) onto `rows`, left or inner.

    A group of more than `split_rows` rows is spread over as many salts as it has that many rows, and its statistics are copied to
    each. The salts of these groups are broadcast: there is at most one such group for every `split_rows` rows.
    """
    values = [c for c in stats.columns if c not in keys]
    parts = F.greatest(F.ceil(F.col(n) / F.lit(split_rows)), F.lit(1)).cast("bigint")
    large = stats.filter(F.col(n) > split_rows).select(*keys, parts.alias("_parts"))
    salted = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    salt = F.pmod(F.xxhash64(*salt_by), F.coalesce("_parts", F.lit(1)))
    spread = rows.join(F.broadcast(large), keys, "left").withColumn("_salt", salt).drop("_parts")
    return spread.join(salted, [*keys, "_salt"], how).select(*rows.columns, *values)


def with_carried_rows(
    chunked: DataFrame, key: str, order: list[str], preceding: int, split_rows: int = SPLIT_ROWS, sizes: DataFrame | None = None
) -> DataFrame:
    """Give each chunk a copy of the group's rows before it, at least `preceding` of them where there are as many, marked `carried`.

    A window over (key, chunk) of at most that many preceding rows then sees what it would see over the key. Only groups of more than
    `split_rows` rows stay cut: their chunks are joined up to parts of about that many rows, and of the part before it a part gets the last
    chunks that hold `preceding` rows. All other groups become one chunk, which needs no copies, so rows are copied for large
    groups alone. The parts of these are broadcast: at most one such group for every `split_rows` rows, with its calendar chunks.

    `order` has to follow the chunks. `sizes` holds `key` and `chunk` of the same rows, where they are known from less work.
    """
    sizes = chunked.select(key, "chunk") if sizes is None else sizes
    large = sizes.groupBy(key).count().filter(F.col("count") > split_rows).select(F.col(key).alias("_key"))
    cut = sizes.join(F.broadcast(large), F.col(key).eqNullSafe(F.col("_key"))).groupBy("_key", "chunk").agg(F.count("*").alias("_n"))
    by_chunk = Window.partitionBy("_key").orderBy("chunk")
    end = F.sum("_n").over(by_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = cut.withColumn("_end", end).withColumn("_part", F.floor((F.col("_end") - F.col("_n")) / F.lit(split_rows)))
    starts = F.collect_set(F.struct(F.col("_part").alias("part"), F.col("_start").alias("start"))).over(Window.partitionBy("_key"))
    first = F.min(F.col("_end") - F.col("_n")).over(Window.partitionBy("_key", "_part"))
    later = F.filter("_parts", lambda p: (p["part"] > F.col("_part")) & (p["start"] - F.col("_end") < preceding))
    copies = F.concat(
        F.array(F.struct(F.col("_part").alias("chunk"), F.lit(False).alias("carried"))),
        F.transform(later, lambda p: F.struct(p["part"].alias("chunk"), F.lit(True).alias("carried"))),
    )
    parts = placed.withColumn("_start", first).withColumn("_parts", starts).select("_key", F.col("chunk").alias("_chunk"), copies.alias("_copies"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("chunk"), F.lit(False).alias("carried")))
    met = F.col(key).eqNullSafe(F.col("_key")) & F.col("chunk").eqNullSafe(F.col("_chunk"))
    spread = chunked.join(F.broadcast(parts), met, "left")
    return spread.select(*[c for c in chunked.columns if c != "chunk"], F.inline(F.coalesce("_copies", whole)))


def newest_chunk(ts: str, chunk_by: str) -> Column:
    """A number for each calendar chunk that falls as time goes on, for orders from the newest; a NULL time is the last chunk."""
    days = F.datediff(F.trunc(F.to_date(ts), chunk_by), F.lit("1970-01-01").cast("date"))
    return F.coalesce(-days, F.lit(2**31 - 1))


def rank_within(rows: DataFrame, key: str, chunk: Column, order: list[Column], name: str) -> DataFrame:
    """Number each group's rows 1, 2, 3, ... in `order` (a total order), chunk by chunk.

    `chunk` is a number that never falls along the order and is not NULL.
    """
    chunked = rows.withColumn("chunk", chunk)
    within = F.row_number().over(Window.partitionBy(key, "chunk").orderBy(*order))
    offsets = running_offsets(chunked, key, {"_before": F.count("*")})
    numbered = chunked.join(offsets, [key, "chunk"]).withColumn(name, (within + F.col("_before")).cast("int"))
    return numbered.drop("chunk", "_before")


def running_offsets(chunked: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Per (key, chunk): the given additive aggregates over the group's earlier chunks, 0 for the first."""
    earlier = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy(key, "chunk").agg(*[agg.alias(name) for name, agg in sums.items()])
    return totals.withColumns({n: F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in sums})
