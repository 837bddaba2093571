"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

1. A document's distinct word shingles are hashed once; the hash space is cut into 128 bins and the least hash of each bin is
   kept (one permutation). An empty bin copies that of another bin, found by a random walk of its own that is the
   same for all documents (optimal densification), so bins agree with the probability of the similarity.
2. 32 bands of 4 bins give bucket keys. At a similarity of 0.8, two documents share no bucket with probability below 10**-7.
3. Documents of one shingle set are one node from here on. In a bucket, each member is paired with the smallest one only: a
   star, so pairs grow with members, not with their square. Pairs are confirmed on the full sets.
4. A star can miss a link between two members that are both unlike its centre. So where the members of a star are not all in
   one component by then, those outside its largest component are compared with all of them: blocks of at most about 256 by 256
   documents meet, one product of incidence matrices counts all common shingles, and links alone come out. Pairs within the largest
   component need no test. So no link between documents that share a bucket is lost, and no pair is emitted that isn't one.

Components are found with ``components``. Nothing is collected but counts.

Defined results: a null text has no words; documents without words have an empty set and no links; fewer words than a shingle count
as one shingle; rows of the same id are one document, linked if any of its rows is; rows without an id are left out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.components import connected_components
from tallyflow.llm.kernels import U, Words, mix, slices
from tallyflow.llm.rendezvous import bound_batches, shared_folder

WORDS = 5
PERCENT = 85
BANDS, BAND_BINS = 32, 4
#: Documents of a block in which members of a star are compared with each other.
BLOCK = 256
#: Parts of a star when its members are given their blocks.
STAR_SALTS = 16
_BIN_BITS = 7
BINS = 1 << _BIN_BITS
_SIGNATURES = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
_SETS = "doc_id long, shingles binary"


def shingle_sets(ids: np.ndarray, buf: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each document of a slice, sorted."""
    words = Words(buf, offsets, lower=True)
    ranges = words.ranges()
    hashes = ranges.windows(size)
    first = words.first
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
    whole = dict(zip(short.tolist(), ranges(first[short], first[short + 1]), strict=True))
    none = np.zeros(0, U)
    out = []
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= size:
            out.append(np.unique(hashes[a : b - size + 1]))
        else:
            out.append(np.array([whole[k]], U) if k in whole else none)
    return out


def densified(bins: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Bins of documents with at least one filled bin; each empty one takes the value of the first filled bin on its walk."""
    out = bins.copy()
    doc, at = np.nonzero(~filled)
    step = 0
    while len(doc):
        source = (mix((at.astype(U) << U(32)) + U(step + 1)) >> U(64 - _BIN_BITS)).astype(np.int64)
        hit = filled[doc, source]
        out[doc[hit], at[hit]] = bins[doc[hit], source[hit]]
        doc, at = doc[~hit], at[~hit]
        step += 1
    return out


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = BAND_BINS) -> np.ndarray:
    """Bucket keys of non-empty sets, one row each."""
    values = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (values >> U(64 - _BIN_BITS)).astype(np.int64)
    head = np.ones(len(values), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    bins, filled = np.zeros((len(sets), BINS), U), np.zeros((len(sets), BINS), bool)
    bins[doc[head], at[head]] = values[head]
    filled[doc[head], at[head]] = True
    bins = mix(densified(bins, filled))
    need = bands * rows
    if need > BINS:
        raise ValueError(f"bands * rows is at most {BINS}")
    keys = np.zeros((len(sets), bands), U)
    for r in range(rows):
        keys = mix(keys * U(0x9E3779B97F4A7C15) + bins[:, r:need:rows])
    return mix(keys + np.arange(1, bands + 1, dtype=U))


def _signatures(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, hi, buf, offsets in slices(batch.column("text")):
                sets = shingle_sets(ids[lo:hi], buf, offsets, size)
                some = [s for s in sets if len(s)]
                keys = iter(band_keys(some, bands, rows).view(np.int64).tolist() if some else [])
                yield pa.record_batch([
                    pa.array(ids[lo:hi]), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([mix(s).sum(dtype=U) for s in sets], U).view(np.int64)),
                    pa.array(np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) for s in sets], U).view(np.int64)),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ], names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return sign


def _sets(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, hi, buf, offsets in slices(batch.column("text")):
                sets = shingle_sets(ids[lo:hi], buf, offsets, size)
                yield pa.record_batch([pa.array(ids[lo:hi]), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    return make


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs that are links."""
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = np.frombuffer(a, U), np.frombuffer(b, U)
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(a) + len(b) - common) > 0)
            kept = batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))
            yield kept

    return confirm


def _confirm_block(percent: int):
    def confirm(rows: pa.Table) -> pa.Table:
        """Links between the asking and the other documents of a block, from the product of their incidence matrices."""
        asks = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, component = rows.column("m").to_numpy(), rows.column("component").to_numpy()
        sets = [np.frombuffer(x, U) for x in rows.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        ours, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        common = np.zeros((len(ours), len(theirs)), np.float32)
        turn = np.zeros(len(sets), np.int64)
        turn[ours], turn[theirs] = np.arange(len(ours)), np.arange(len(theirs))
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, int(column.max(initial=-1)) + 1, 2048):
            a, b = np.searchsorted(column, [lo, lo + 2048])
            r, c = row[a:b], column[a:b] - lo
            left, right = np.zeros((len(ours), 2048), np.float32), np.zeros((2048, len(theirs)), np.float32)
            left[turn[r[asks[r]]], c[asks[r]]] = 1
            right[c[~asks[r]], turn[r[~asks[r]]]] = 1
            common += left @ right
        common = common.astype(np.int64)
        joint = size[ours][:, None] + size[theirs][None, :] - common
        i, j = np.nonzero((100 * common >= percent * joint) & (component[ours][:, None] != component[theirs][None, :]))
        u, v = ids[ours[i]], ids[theirs[j]]
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return confirm


def _pairs(x: str, y: str) -> list:
    return [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, band_bins: int = BAND_BINS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents are linked if 100 * |intersection| >= percent * |union| of their shingles;
    ``component_id`` is the smallest id reachable over links, and ``kept`` says that it is the document's own."""
    shared_folder(docs.sparkSession)
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    signed = texts.mapInArrow(_signatures(words, bands, band_bins), _SIGNATURES).checkpoint()

    # documents of one set: the smallest stands for them
    same = ["n_shingles", "s1", "s2"]
    filled = signed.where("n_shingles > 0")
    copies = filled.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    copy_edges = filled.select("doc_id", *same).join(copies, same).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    distinct = filled.join(copies, same).where("doc_id = rep").select("doc_id", "n_shingles", "bands")
    buckets = distinct.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    centres = buckets.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("c"), F.count("*").alias("members")).where("members > 1")
    members = (
        buckets.join(centres, "key").select("key", "doc_id", "n", F.col("c.doc_id").alias("centre"), F.col("c.n").alias("centre_n"), "members").checkpoint()
    )  # only buckets with two members or more
    like = F.expr(f"100 * least(n, centre_n) >= {int(percent)} * greatest(n, centre_n)")
    tested = members.where(F.col("doc_id") != F.col("centre")).where(like).select(*_pairs("doc_id", "centre")).distinct().checkpoint()

    wanted = members.select("doc_id").distinct()  # centres are members too
    sets = texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(words), _SETS).checkpoint()

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
        right = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
        return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_confirm(percent), "u long, v long").distinct()

    links = confirmed(tested).union(copy_edges).checkpoint()
    # members of a star that its centre doesn't hold together: those outside the largest component against all of it
    star = members.select(F.col("centre").alias("c"), F.col("doc_id").alias("m")).distinct()
    labels = connected_components(links).checkpoint().withColumnRenamed("node", "m")
    star = star.join(labels, "m", "left").withColumn("component", F.coalesce("component", "m")).checkpoint()
    sizes = star.groupBy("c", "component").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("c").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most")
    blocks = open_.select("c", "largest", F.ceil(F.col("all") / BLOCK).alias("mb"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("ob"))
    # a star may hold a third of all documents: its members are dealt over salts of its centre; open stars, a row each, meet every salt
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(STAR_SALTS - 1))))
    rest = star.withColumn("salt", F.pmod(F.xxhash64("m"), F.lit(STAR_SALTS)).cast("int")).join(salted, ["c", "salt"])
    block = lambda n: F.pmod(F.xxhash64("m", F.lit(1)), F.col(n)).alias(n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(n)
    here = rest.select("c", block("mb"), every("ob"), "m", "component", F.lit(False).alias("asks"))
    there = rest.where("component <> largest").select("c", every("mb"), block("ob"), "m", "component", F.lit(True).alias("asks"))
    met = here.union(there).join(sets.withColumnRenamed("doc_id", "m"), "m")
    more = met.groupBy("c", "mb", "ob").applyInArrow(_confirm_block(percent), "u long, v long").distinct()
    components = connected_components(links.union(more)).checkpoint()
    label = components.select(F.col("node").alias("doc_id"), "component")
    out = signed.select("doc_id", "n_shingles").join(label, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
