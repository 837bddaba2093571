"""Line dedup: frequent lines stay only in the document with the largest id; keep bitmaps instead of texts.

Method: every line's key is hashed once per document. The hashes are dealt by range of (hash, document) and sorted, so the
occurrences of a key stream past in falling order of document: the first document keeps its lines, the others lose theirs as
soon as enough documents have been seen. The document is part of the range, so a key that a third of all documents
hold is spread over many partitions; each partition reports the keys at its two ends, which is all that crosses its borders.

A key is a line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case. Keys are equal if two independent 64-bit
hashes are.

Defined results: a null or empty text is one empty line; keys below ``min_chars`` code points stay; rows of the same id are one document,
so what it holds twice in a row or in two rows counts once; rows without an id have no bitmap and keep their text, null n_lines and
n_dropped; other columns are kept, but for such as are called n_lines or n_dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.kernels import _BYTE_VALUES, LOWER, SPACE, Ranges, mix, slices
from tallyflow.llm.rendezvous import bound_batches, shared_folder

MIN_CHARS = 40
MIN_DOCS = 5
_LINES = "h1 long, h2 long, doc_id long, text_hash long, n_lines int, places binary"
_LINES_SCHEMA = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_lines", pa.int32()), ("places", pa.binary())])
_SECOND_BASE = 0xA0761D6478BD642F | 1


def line_keys(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line of a slice: its document, number within it, code points of its key, and two hashes of the key."""
    breaks = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # a break at the end of a document starts an empty line of that document, which sorts before the next document's first line
    owner = np.searchsorted(offsets[1:-1], np.concatenate([offsets[:-1], breaks]), "right")
    owner[: len(offsets) - 1] = np.arange(len(offsets) - 1)
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((np.concatenate([np.zeros(len(offsets) - 1, int), np.ones(len(breaks), int)]), start, owner))
    start, owner = start[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(offsets) - 1))
    number = np.arange(len(owner)) - first[owner]
    last = np.concatenate([number[1:] == 0, [True]])
    end = np.where(last, offsets[owner + 1], np.concatenate([start[1:], [0]]) - 1)
    solid = np.flatnonzero(~SPACE[buf])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    empty = a == b
    solid = np.concatenate([solid, [0]])
    from_ = np.where(empty, start, solid[a])
    to = np.where(empty, start, solid[b - 1] + 1)
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    lower = LOWER[buf]
    values = _BYTE_VALUES[lower]
    h1 = Ranges(values, 0x9E3779B97F4A7C15 | 1)(from_, to)
    h2 = Ranges(mix(values), _SECOND_BASE)(from_, to)
    return owner, number, points[to] - points[from_], h1, h2


def _find_lines(min_chars: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
            for lo, hi, buf, offsets in slices(batch.column("text")):
                doc, number, points, h1, h2 = line_keys(buf, offsets)
                n_lines = np.bincount(doc, minlength=hi - lo).astype(np.int32)
                use = points >= min_chars
                doc, number, h1, h2 = doc[use], number[use].astype(np.int32), h1[use].view(np.int64), h2[use].view(np.int64)
                order = np.lexsort((number, h2, h1, doc))
                doc, number, h1, h2 = doc[order], number[order], h1[order], h2[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                at = np.flatnonzero(new)
                ends = np.concatenate([at[1:], [len(doc)]])[: len(at)]
                places = [number[s:e].tobytes() for s, e in zip(at.tolist(), ends.tolist(), strict=True)]
                # one row without a key for each document carries its number of lines
                k = hi - lo
                null = np.concatenate([np.ones(k, bool), np.zeros(len(at), bool)])
                which = np.concatenate([np.arange(k), doc[at]])
                yield pa.record_batch([
                    pa.array(np.concatenate([np.zeros(k, np.int64), h1[at]]), mask=null),
                    pa.array(np.concatenate([np.zeros(k, np.int64), h2[at]]), mask=null),
                    pa.array(ids[lo:hi][which]), pa.array(hashes[lo:hi][which]), pa.array(n_lines[which]),
                    pa.array([b""] * k + places, pa.binary()),
                ], schema=_LINES_SCHEMA)

    return find


def _runs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    new = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(h1)]])


_ENDS = "h1 long, h2 long, part int, n long, high long, low long"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last key of a partition: documents, and the largest and smallest of them."""
    first, run = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc_id"))
        part = batch.column("part")[0].as_py()
        bounds = _runs(h1, h2)
        for s, e in [(bounds[0], bounds[1])] + ([(bounds[-2], bounds[-1])] if len(bounds) > 2 else []):
            n = 1 + int((doc[s + 1 : e] != doc[s : e - 1]).sum())
            if run and run[:2] == [int(h1[s]), int(h2[s])]:
                run[3] += n - (run[5] == int(doc[s]))
                run[5] = int(doc[e - 1])
            else:
                if run and first is None:
                    first = run
                run = [int(h1[s]), int(h2[s]), part, n, int(doc[s]), int(doc[e - 1])]
    rows = [r for r in (first, run) if r]
    yield pa.RecordBatch.from_pylist([dict(zip(("h1", "h2", "part", "n", "high", "low"), r, strict=True)) for r in rows],
                                     schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]))


_DROPPED = "doc_id long, text_hash long, n_lines int, places binary"


def _stream(min_docs: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose lines go. Rows of a key wait only until ``min_docs`` documents of it have been seen."""
        held: pa.Table | None = None
        known = None  # the key of the last run once it is decided: h1, h2, largest document
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held else table
            held = None
            h1, h2, doc = (table.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
            total = table.column("n_all").fill_null(0).to_numpy()
            high = table.column("high_all").fill_null(0).to_numpy()
            bounds = _runs(h1, h2)
            new_doc = np.ones(len(doc), bool)
            new_doc[1:] = doc[1:] != doc[:-1]
            new_doc[bounds[:-1]] = True
            n = np.add.reduceat(new_doc.astype(np.int64), bounds[:-1])
            most = doc[bounds[:-1]]
            crossing = total[bounds[:-1]] > 0
            n = np.where(crossing, total[bounds[:-1]], n)
            most = np.where(crossing, high[bounds[:-1]], most)
            if known and known[:2] == (int(h1[0]), int(h2[0])):
                n[0], most[0] = max(n[0], min_docs), known[2]
            size = np.diff(bounds)
            gone = np.repeat(n >= min_docs, size) & (doc < np.repeat(most, size))
            if n[-1] >= min_docs:
                known = (int(h1[-1]), int(h2[-1]), int(most[-1]))
            else:
                known = None
                if not crossing[-1]:
                    held = table.slice(bounds[-2])
            yield from table.filter(pa.array(gone)).select(["doc_id", "text_hash", "n_lines", "places"]).to_batches()

    return stream


_KEEP = "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary"


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped, maps = [], []
        for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("places").to_pylist(), strict=True):
            keep = np.ones(n, np.uint8)
            keep[np.frombuffer(b"".join(places), np.int32)] = 0
            dropped.append(n - int(keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.record_batch([
            batch.column("doc_id"), batch.column("text_hash"), batch.column("n_lines").cast(pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary()),
        ], names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep) for every distinct (id, text): ``keep`` is a zlib-compressed bitmap with a bit per line."""
    shared_folder(docs.sparkSession)
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    lines = texts.mapInArrow(_find_lines(min_chars), _LINES).checkpoint()  # read twice: ranges are drawn from a first pass
    order = ("h1", "h2", F.desc("doc_id"))
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()  # so that partitions stay as they are
    keyed = dealt.where("h1 IS NOT NULL")
    ends = keyed.select("h1", "h2", "doc_id", F.spark_partition_id().alias("part")).mapInArrow(_ends, _ENDS)
    # at most two rows for each partition, whatever the data
    crossing = (
        ends.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("part", "n", "high", "low"))).alias("e"), F.count_distinct("part").alias("parts"))
        .where("parts > 1")
        .select("h1", "h2", F.expr("aggregate(e, 0L, (s, x) -> s + x.n) - size(filter(sequence(1, size(e) - 1), i -> e[i].high = e[i - 1].low))").alias("n_all"), F.col("e")[0]["high"].alias("high_all"))
    )
    dropped = keyed.join(F.broadcast(crossing), ["h1", "h2"], "left").mapInArrow(_stream(min_docs), _DROPPED)
    every = dealt.where("h1 IS NULL").select("doc_id", "text_hash", "n_lines", "places")
    return (
        every.unionByName(dropped).groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_list("places").alias("places"))
        .mapInArrow(_bitmaps, _KEEP)
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, n, dropped, keep in zip(*(batch.column(c).to_pylist() for c in ("_text", "_n_lines", "_n_dropped", "_keep")), strict=True):
            if dropped:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
                text = "\n".join([line for line, bit in zip(text.split("\n"), bits.tolist(), strict=True) if bit])
            out.append(text)
        at = batch.schema.get_field_index("_text")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)


def keep_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines as text, and n_lines and n_dropped in columns of that name (replaced if there are such)."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # the other columns travel in one, so that their names can't clash
    others = F.struct(*(F.col(f"`{c}`") for c in columns if c != text_col)).alias("_row")
    left = docs.select(others, F.col(f"`{id_col}`").cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"))
    right = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"), F.col("keep").alias("_keep"))
    joined = left.join(right, ["_id", "_hash"], "left")
    out = joined.mapInArrow(_apply, joined.schema)
    kept = [F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in columns]
    return out.select(*kept, F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` with the kept lines as text, plus n_lines and n_dropped."""
    return keep_lines(docs, line_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)
