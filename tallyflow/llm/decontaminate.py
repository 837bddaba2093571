"""Benchmark decontamination: documents that hold a passage of a benchmark, up to a few edits.

Method: q-gram lemma filtering. An item is cut into overlapping probes. If a region of a document is within e edits of a probe of m
characters, they share at least m - q + 1 - q * e q-grams, and all on at most e + 1 neighbouring diagonals (place in the document
less place in the probe). So shared q-grams are counted in bands of 2 * (e + 1) diagonals that overlap by half; every such run of
diagonals lies within one band. Bands that meet the bound are verified by an alignment within the band, which is
exact for that reason. Characters are code points; A-Z are lowered and white space counts as a blank.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text, so what is broadcast is bounded whatever its size: a larger
benchmark takes more passes. Documents are only mapped, never shuffled.

With ``passage`` = n (by default 50), items are also cut into probes of n - STEP + 1 characters every ``STEP`` characters, as long as a probe has ``min_chars``.
Every passage of n characters of an item then holds a whole such probe wherever it starts, so a document that quotes n
characters is found, and with up to rate * (n - STEP + 1) edits in them too (two of 50).

Defined results: null texts are empty; items below ``min_chars`` code points are no evidence and match nothing, longer ones are found if one
probe of theirs is; items of the same id count as one; rows without an id are left out of the pairs, and stay as they are in the filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tallyflow.llm.kernels import LOWER, SPACE, U, Ranges, mix, slices
from tallyflow.llm.rendezvous import bound_batches

Q = 12
PROBE = 96
MIN_CHARS = 24
EDIT_RATE = 0.05
#: Characters of the shortest passage of a longer item that the query and the pipeline look for, and the step of its probes.
PASSAGE, STEP = 50, 7
BLOCK_BYTES = 4 << 20
_BASE = 0xE7037ED1A0B428DB | 1
_FILTER_BITS = 22
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[:] = LOWER[:128]
_FOLD[SPACE[:128]] = 32
#: Shared q-grams taken at a time.
AT_ONCE = 1 << 20


def code_points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a slice of UTF-8 texts, and the offsets of the texts in them."""
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    ascii_ = points < 128
    points[ascii_] = _FOLD[points[ascii_]]
    starts = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=starts[1:])
    return points, starts[offsets]


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    return Ranges(mix(points.astype(U) + U(1)), _BASE).windows(q)


class Probes:
    """Probes of some items with an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int, probe: int, min_chars: int, rate: float, passage: int | None = None) -> None:
        if passage is not None and passage - STEP + 1 < max(min_chars, q):
            raise ValueError(f"a passage must have at least {max(min_chars, q) + STEP - 1} characters")
        self.q = q
        texts, self.item = [], []
        for item, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            points, _ = code_points(data, np.array([0, len(data)]))
            if len(points) < max(min_chars, q):
                continue
            cuts = [(probe, max(probe // 2, 1))]
            if passage is not None and len(points) >= passage:
                cuts.append((passage - STEP + 1, STEP))
            for size, step in cuts:
                last = max(len(points) - size, 0)
                for at in sorted({*range(0, last, step), last}):
                    texts.append(points[at : at + size])
                    self.item.append(item)
        self.item = np.array(self.item, np.int64)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.edits = np.minimum((self.size * rate).astype(np.int64), (self.size - q) // q)
        self.need = self.size - q + 1 - q * self.edits
        self.texts = texts
        grams = [gram_hashes(t, q) for t in texts]
        where = [(np.full(len(g), i), np.arange(len(g))) for i, g in enumerate(grams)]
        grams = np.concatenate([*grams, np.zeros(0, U)])
        order = np.argsort(grams, kind="stable")
        self.probe = np.concatenate([*(w[0] for w in where), np.zeros(0, int)])[order]
        self.place = np.concatenate([*(w[1] for w in where), np.zeros(0, int)])[order]
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(grams)))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.grams >> U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (document, probe, band) that share enough q-grams; band b holds diagonals from b * (edits + 1) - size on."""
        hashes = gram_hashes(points, self.q)
        at = np.flatnonzero(self.filter[(hashes >> U(64 - _FILTER_BITS)).astype(np.int64)])
        gram = np.searchsorted(self.grams, hashes[at])
        gram[gram == len(self.grams)] = 0
        doc = np.searchsorted(offsets, at, "right") - 1
        true = (self.grams[gram] == hashes[at]) & (at + self.q <= offsets[doc + 1])
        at, gram, doc = at[true], gram[true], doc[true]
        ends = np.cumsum(self.count[gram])
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        lo = 0
        width = int(offsets[-1]) + int(self.size.max()) + 2
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
            times = self.count[gram[lo:hi]]
            entry = np.repeat(self.first[gram[lo:hi]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            probe = self.probe[entry]
            diagonal = np.repeat(at[lo:hi] - offsets[doc[lo:hi]], times) - self.place[entry] + self.size[probe]
            band = diagonal // (self.edits[probe] + 1)
            key = (np.repeat(doc[lo:hi], times) * len(self.item) + probe) * width + band
            counted.append(np.unique(np.concatenate([key, key[band > 0] - 1]), return_counts=True))
            lo = hi
        if not counted:
            return np.zeros((0, 3), np.int64)
        keys, back = np.unique(np.concatenate([c[0] for c in counted]), return_inverse=True)
        total = np.bincount(back, np.concatenate([c[1] for c in counted]), len(keys)).astype(np.int64)
        probe = keys // width % len(self.item)
        keys, probe = keys[total >= self.need[probe]], probe[total >= self.need[probe]]
        return np.stack([keys // width // len(self.item), probe, keys % width], axis=1)

    def verified(self, points: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Edits of the best alignment of each candidate within its band."""
        out = np.zeros(len(rows), np.int64)
        for size, edits in {*zip(self.size[rows[:, 1]].tolist(), self.edits[rows[:, 1]].tolist(), strict=True)}:
            mine = np.flatnonzero((self.size[rows[:, 1]] == size) & (self.edits[rows[:, 1]] == edits))
            for lo in range(0, len(mine), 1024):
                some = rows[mine[lo : lo + 1024]]
                pattern = np.stack([self.texts[p] for p in some[:, 1]])
                begin, end = offsets[some[:, 0]], offsets[some[:, 0] + 1]
                out[mine[lo : lo + 1024]] = _band_distance(points, begin, end, pattern, some[:, 2] * (edits + 1) - size, 2 * (edits + 1))
        return out

    def find(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document of the slice, item, edits) of what is held, by document and item."""
        empty = np.zeros(0, np.int64)
        if not len(self.item) or not len(buf):
            return empty, empty, empty
        points, offsets = code_points(buf, offsets)
        rows = self.candidates(points, offsets)
        if not len(rows):
            return empty, empty, empty
        edits = self.verified(points, offsets, rows)
        held = edits <= self.edits[rows[:, 1]]
        doc, item, edits = rows[held, 0], self.item[rows[held, 1]], edits[held]
        order = np.lexsort((edits, item, doc))
        doc, item, edits = doc[order], item[order], edits[order]
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        return doc[first], item[first], edits[first]


def _band_distance(points: np.ndarray, begin: np.ndarray, end: np.ndarray, pattern: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Least edits between each pattern and any part of its document on paths within ``width`` diagonals from ``low`` on."""
    steps = np.arange(width)
    cost = np.zeros((len(pattern), width), np.int64)
    far = len(points) + 1
    for i in range(pattern.shape[1]):
        place = begin[:, None] + low[:, None] + i + steps
        inside = (place >= begin[:, None]) & (place < end[:, None])
        text = points[np.clip(place, 0, len(points) - 1)]
        kept = cost + ~(inside & (text == pattern[:, i : i + 1]))
        dropped = np.concatenate([cost[:, 1:] + 1, np.full((len(cost), 1), far)], axis=1)
        cost = np.minimum(kept, dropped)
        cost = np.minimum.accumulate(cost - steps, axis=1) + steps
    return cost.min(axis=1)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most about ``block_bytes`` of text."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / block_bytes))
    for block in range(n):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).collect()]


_HELD = ArrayType(StructType([StructField("item_id", LongType()), StructField("edits", LongType())]))
_HELD_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64())]))


def with_held_items(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", held: str = "held_items", item_id: str = "item_id", item_text: str = "text",
    q: int = Q, probe: int = PROBE, min_chars: int = MIN_CHARS, rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES,
    passage: int | None = PASSAGE,
) -> DataFrame:
    """``docs`` with a column of the benchmark items that each document holds, an array of (item_id, edits). With ``passage`` None,
    excerpts shorter than ``probe`` of longer items are not looked for."""
    spark = docs.sparkSession
    bound_batches(spark)
    out = docs.withColumn(held, F.lit(None).cast(_HELD))
    schema = out.schema
    for items in _blocks(benchmark, item_id, item_text, block_bytes):
        given = spark.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            probes = Probes(given.value, q, probe, min_chars, rate, passage)
            for batch in batches:
                before = batch.column(batch.schema.get_field_index(held)).to_pylist()
                texts = batch.column(batch.schema.get_field_index(text_col))
                for lo, _, buf, offsets in slices(texts):
                    for doc, item, edits in zip(*(x.tolist() for x in probes.find(buf, offsets)), strict=True):
                        before[lo + doc] = [*(before[lo + doc] or []), {"item_id": item, "edits": edits}]
                columns = [*batch.columns]
                columns[batch.schema.get_field_index(held)] = pa.array(before, _HELD_ARROW)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        out = out.mapInArrow(find, schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, edits): a row for each benchmark item that a document holds, with the edits of its best probe."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    held = with_held_items(rows, benchmark, **options).select("doc_id", F.explode("held_items").alias("h")).select("doc_id", "h.item_id", "h.edits")
    return held


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    return with_held_items(docs, benchmark, text_col, held="_held_items", **options).where("_held_items IS NULL").drop("_held_items")
