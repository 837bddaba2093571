"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are dealt into blocks by a hash of their id. The index of a block has, for every dimension, posting segments: the
vectors whose component falls into one range of values. For a query, a segment adds at least a base (the least product of its
dimension) plus its impact; impacts are quantised, and the segments of all dimensions are taken in falling order of impact.
After each level of impacts every vector has a lower bound of its score, and what is left bounds how much more it
can get. Vectors whose upper bound is below the k-th best lower bound are out by proof; when few possible members remain,
processing stops and these are rescored exactly. How early it stops only changes the time taken.

Queries are dealt into blocks too, and each query block meets each index block once: the stated query set against all rows,
in blocks. A block returns k rows per query, which are merged by an aggregate.

Defined results: vectors that are null or hold a null, NaN or infinite component, or whose id is null, take no part; nor do vectors of another
length than a query's in that query's result; ties go to the smaller id; an id that is repeated is one candidate and one query, the score
of two ids being the highest over their rows; components whose products may not fit 64 bits are an error; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.rendezvous import stored_bytes

BLOCK_BYTES = 8 << 20
STEP = 8  # values per posting segment
LEVELS = 8  # quantised impacts
FEW = 64  # so few possible members, or a sixteenth of a block, are rescored without further processing
_BLOCK = "block long, dims int, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score long"


def quantised(embedding: Column, scale: float) -> Column:
    """floor(scale * x) of every component, null if one is null or not finite. Values that 64 bits don't hold are an error."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    large = F.raise_error(F.lit("a component is too large for 64-bit products")).cast("bigint")

    def value(x: Column) -> Column:
        wide = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(wide) >= F.lit(2.0**62), large).otherwise(F.floor(wide))

    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & ~bad, F.transform(embedding, value))


def _pack(rows: pa.Table) -> pa.Table:
    """Vectors of a group as one row."""
    values = rows.column("q").combine_chunks()
    values = (pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values).flatten().to_numpy().astype(np.int64)
    return pa.table({
        "block": rows.column("block").slice(0, 1), "dims": rows.column("dims").slice(0, 1),
        "ids": pa.array([rows.column("vec_id").to_numpy().tobytes()], pa.binary()), "vectors": pa.array([values.tobytes()], pa.binary()),
    })


class Index:
    """Posting segments of a block: for each dimension the vectors in order of the component, cut at multiples of STEP."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.int64)
        n, dims = self.vectors.shape
        self.postings, start, self.dim, self.low, self.high = [], [], [], [], []
        at = 0
        for d in range(dims):
            column = self.vectors[:, d]
            by_value = np.argsort(column, kind="stable")
            cells = column[by_value] // STEP
            heads = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1])
            ends = np.concatenate([heads[1:], [n]])
            self.postings.append(by_value.astype(np.int32))
            start.append(heads + at)
            self.dim.append(np.full(len(heads), d))
            self.low.append(column[by_value][heads])
            self.high.append(column[by_value][ends - 1])
            at += n
        self.postings = np.concatenate(self.postings)
        self.start = np.concatenate(start)
        self.end = np.concatenate([self.start[1:], [at]])
        self.dim, self.low, self.high = map(np.concatenate, (self.dim, self.low, self.high))
        self.largest = float(np.abs(self.vectors).max())
        self.repeats = int(np.unique(self.ids, return_counts=True)[1].max())
        self.first_of_dim = np.flatnonzero(np.concatenate([[True], np.diff(self.dim) != 0]))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best vectors with another id, ties to the smaller id; more where ids are repeated."""
        k *= self.repeats
        query = query.astype(np.int64)
        if 8.0 * len(query) * float(np.abs(query).max()) * self.largest >= 2.0**63:  # bounds are sums of a few such products
            raise OverflowError("components are too large for 64-bit products")
        weight = query[self.dim]
        least = np.minimum(weight * self.low, weight * self.high)
        most = np.maximum(weight * self.low, weight * self.high)
        base = np.minimum.reduceat(least, self.first_of_dim)
        gain = least - base[self.dim]  # at least this much over the base of the dimension
        reach = most - base[self.dim]  # at most this much
        slack = int(np.maximum.reduceat(reach - gain, self.first_of_dim).sum())
        unit = max(1, -(-int(gain.max()) // LEVELS))
        impact = gain // unit
        slack += (unit - 1) * len(base)
        order = np.argsort(-impact, kind="stable")
        ranked = impact[order]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(ranked)) + 1, [len(order)]])
        n = len(self.ids)
        total = np.zeros(n, np.int64)
        own = self.ids == query_id
        members = np.arange(n)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            level = int(ranked[a])
            if level == 0:
                break
            hits = np.concatenate([self.postings[s:e] for s, e in zip(self.start[order[a:b]].tolist(), self.end[order[a:b]].tolist(), strict=True)])
            total += np.bincount(hits, minlength=n) * level
            # an unprocessed segment adds less than the best that is left of its dimension
            rest = np.zeros(len(base), np.int64)
            left = order[b:]
            np.maximum.at(rest, self.dim[left], impact[left])
            lower = total[~own]
            if len(lower) > k:
                kth = int(np.partition(lower, len(lower) - k)[len(lower) - k])
                members = np.flatnonzero((total + rest.sum()) * unit + slack >= kth * unit)
                if len(members) <= max(FEW, n // 16):
                    break
        members = members[~own[members]]
        scores = self.vectors[members] @ query
        best = np.lexsort((self.ids[members], -scores))[:k]
        return members[best], scores[best]


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block: index rows first, then the query blocks that meet them, one at a time."""
        name, indexes = None, {}
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = np.frombuffer(row["ids"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), -1)
                if name != row["block"]:
                    name, indexes = row["block"], {}
                if not row["asks"]:
                    indexes[row["dims"]] = Index(ids, vectors)
                    continue
                index = indexes.get(row["dims"])
                if index is None:
                    continue
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for query_id, query in zip(ids.tolist(), vectors, strict=True):
                    at, scores = index.top(query_id, query, k)
                    out.append((np.full(len(at), query_id), index.ids[at], scores))
                yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return search


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector where ``is_query`` holds, the k other vectors of the highest inner product of
    their components floor(scale * x)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("q"), is_query.alias("asks"))
    rows = rows.where("vec_id IS NOT NULL AND q IS NOT NULL").withColumn("dims", F.size("q"))
    n = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(stored_bytes(vectors) / block_bytes))

    def blocks(df: DataFrame, asks: bool, count: int) -> DataFrame:
        grouped = df.select(F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias("block"), "dims", "vec_id", "q").groupBy("block", "dims")
        return grouped.applyInArrow(_pack, _BLOCK).withColumn("asks", F.lit(asks))

    # query blocks are as large as index blocks, though fewer; a copy of each goes to each index block
    queries = blocks(rows.where("asks"), True, max(2, math.ceil(n / 50)))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    # by range, as a hash would put several blocks into some tasks and none into others
    met = blocks(rows, False, n).unionByName(queries).repartitionByRange(n, "block").sortWithinPartitions("block", "asks")
    found = met.mapInArrow(_search(k), _FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
