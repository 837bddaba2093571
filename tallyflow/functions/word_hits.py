"""Categories from a rule table too large to broadcast: the words are joined to the texts by hashes of short pieces of them.

A word of at most ``EXACT`` letters is looked up whole. Of a longer word one piece stands for it, of 8, 16, 32 or 64 letters, and of its
pieces of that size the one that fewest words hold. Tasks hash the windows of a text of these sizes and keep those that a bitmap of all hashes
knows; the bitmap is at most ``MOST_BITS``, whatever the number of words, and what it lets through by chance is dropped by the join, which
compares the word itself. So a text is read once, and rules meet only texts that hold a piece of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXACT, LONGEST_PIECE = 8, 64
LEAST_BITS, MOST_BITS, BITS_A_WORD = 1 << 16, 1 << 27, 32
BLOCK_BITS = 1 << 16
#: Letters that are hashed at once.
SLICE = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _MIX[0] + right
    out ^= out >> np.uint64(29)
    out *= _MIX[1]
    return out ^ (out >> np.uint64(32))


def window_hashes(points: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Hash of every window of each size, from hashes of windows of half the size."""
    powers = {1: _joined(points.astype(np.uint64), np.zeros(1, np.uint64))}
    while max(sizes) >= 2 * max(powers):
        k = max(powers)
        powers[2 * k] = _joined(powers[k][:-k], powers[k][k:]) if len(powers[k]) > k else np.zeros(0, np.uint64)
    out = {}
    for size in sizes:
        k, done, value = max(powers), 0, None
        while done < size:
            if done + k <= size:
                n = max(len(points) - size + 1, 0)
                part = powers[k][done : done + n]
                value = part if value is None else _joined(value[:n], part)
                done += k
            else:
                k //= 2
        out[size] = value[: max(len(points) - size + 1, 0)] ^ np.uint64(size)
    return out


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the last column, whose strings have the length of the column before it."""
    for batch in batches:
        size, piece = np.array(batch.column(batch.num_columns - 2).to_pylist(), np.int64), batch.column(batch.num_columns - 1).to_pylist()
        out = np.zeros(len(size), np.uint64)
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            out[at] = window_hashes(_points([piece[i] for i in at]), [k])[k][::k]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=[*batch.schema.names, "hash"])


def _pieces(words: DataFrame) -> DataFrame:
    """(word, whole, at, size, piece, hash) of distinct words that are not empty. Of a long word's pieces the one in fewest words."""
    n = F.length("word")
    whole = n <= EXACT
    size = F.when(whole, n).when(n < 16, 8).when(n < 32, 16).when(n < LONGEST_PIECE, 32).otherwise(LONGEST_PIECE).cast("int")
    sized = words.select("word", whole.alias("whole"), size.alias("size"))
    placed = sized.select("*", F.explode(F.sequence(F.lit(0), F.length("word") - F.col("size"))).alias("at"))
    cut = placed.withColumn("piece", F.expr("substring(word, at + 1, size)"))
    held = cut.groupBy("piece").agg(F.count("*").alias("held"))
    best = cut.join(held, "piece").groupBy("word", "whole", "size").agg(F.min(F.struct("held", "piece", "at")).alias("_best"))
    chosen = best.select("word", "whole", F.col("_best.at").alias("at"), "size", F.col("_best.piece").alias("piece"))
    return chosen.mapInArrow(_hashed, "word string, whole boolean, at int, size int, piece string, hash long")


def _bitmap(pieces: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashes; a block of them is put together by tasks."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(np.asarray(batch.column(0)).view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
            blocks = np.unique(bit // BLOCK_BITS)
            marked = [np.packbits(np.bincount(bit[bit // BLOCK_BITS == b] % BLOCK_BITS, minlength=BLOCK_BITS).astype(bool)).tobytes() for b in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(marked, pa.binary())], names=["block", "bits"])

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows.column("bits").to_pylist()])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([whole.tobytes()], pa.binary())})

    kind = "block long, bits binary"
    by_block = pieces.select("hash").mapInArrow(mark, kind).groupBy("block").applyInArrow(merge, kind)
    out = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for row in by_block.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _known(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(8 * len(bitmap) - 1)
    return np.flatnonzero(bitmap[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8)) & 1)


def _windows(texts: DataFrame, shapes: list[tuple[int, bool]], bitmap: np.ndarray, longest: int) -> DataFrame:
    """(key, kind, whole, hash, at, near): windows of the texts that may be a word or a piece; `at` is their place in `near`, the text
    around them as far as a word can reach."""
    given = texts.sparkSession.sparkContext.broadcast(bitmap)

    def found(keys: list[str], kinds: list[str], lowered: list[str]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in lowered], np.int64)
        ends = np.cumsum(sizes)
        hashes = window_hashes(_points(lowered), sorted({k for k, _ in shapes}))
        rows: list[tuple] = []
        for k, whole in shapes:
            start = _known(hashes[k], given.value)
            text = np.searchsorted(ends, start, "right")
            inside = start + k <= ends[text] if len(start) else np.zeros(0, bool)
            start, text = start[inside], text[inside]
            own = hashes[k][start].view(np.int64)
            if whole:  # once a text
                _, first = np.unique(np.stack([text, own]), axis=1, return_index=True)
                start, text, own = start[first], text[first], own[first]
            place = start - (ends - sizes)[text]
            for t, p, h in zip(text.tolist(), place.tolist(), own.tolist(), strict=True):
                low = p if whole else max(p - longest, 0)
                rows.append((keys[t], kinds[t], whole, h, p - low, lowered[t][low : p + (k if whole else longest)]))
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("key", pa.string()), ("kind", pa.string()), ("whole", pa.bool_()), ("hash", pa.int64()), ("at", pa.int32()), ("near", pa.string())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for a, b in slices(columns[2]):
                yield found(*[c[a:b] for c in columns])

    return texts.mapInArrow(match, "key string, kind string, whole boolean, hash long, at int, near string")


def slices(texts: list[str], letters: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many letters, or of one longer text."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > letters:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def first_categories(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, named): category of the first rule that matches, for texts (key, kind, lowered) that any rule matches. Equal keys are equal texts."""
    rules = rules.filter("word IS NOT NULL AND rule_no IS NOT NULL").select("rule_no", "txn_type", "category", "word", "absent")
    absent = rules.filter("absent").groupBy("rule_no").agg(F.collect_set("word").alias("gone"))
    listed = rules.filter("NOT absent").select("rule_no", "txn_type", "category", "word").distinct().join(absent, "rule_no", "left")
    # of the rules of a word and type, those behind one without absent words never win
    sure = F.min(F.when(F.col("gone").isNull(), F.col("rule_no"))).over(Window.partitionBy("word", "txn_type"))
    listed = listed.withColumn("_sure", sure).filter("_sure IS NULL OR rule_no <= _sure").drop("_sure")
    listed = listed.filter("gone IS NULL OR NOT array_contains(gone, '')")
    none = listed.select(F.lit(None).cast(listed.schema["rule_no"].dataType).alias("rule_no"), F.lit(None).cast("string").alias("txn_type"), F.lit(None).cast("string").alias("category"))
    gone_words = rules.filter("absent").select("word").distinct()
    marks = gone_words.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in none.schema], "word", F.lit(None).cast("array<string>").alias("gone"))
    told = listed.select("rule_no", "txn_type", "category", "word", "gone").unionByName(marks)

    pieces = _pieces(rules.select("word").filter("word <> ''").distinct()).localCheckpoint()
    shapes = [(r["size"], r["whole"]) for r in pieces.select("size", "whole").distinct().collect()]
    n, longest = pieces.agg(F.count("*"), F.max(F.length("word"))).first()
    bits = min(max(1 << (BITS_A_WORD * max(n, 1)).bit_length(), LEAST_BITS), MOST_BITS)
    fits = "txn_type IS NULL OR txn_type = kind OR rule_no IS NULL"
    everywhere = texts.select("key", "kind").join(F.broadcast(told.filter("word = ''")), F.expr(fits))
    hits = everywhere.select("key", "rule_no", "category", "word", "gone")
    if shapes:
        windows = _windows(texts, shapes, _bitmap(pieces, bits), longest).withColumnRenamed("at", "place")
        known = told.join(pieces.select("word", "whole", "hash", "at"), "word")
        same = "place >= at AND substring(near, place - at + 1, length(word)) = word"
        met = windows.join(known, ["whole", "hash"]).filter(same).filter(fits)
        hits = met.select("key", "rule_no", "category", "word", "gone").unionByName(hits)
    rule, is_rule = F.struct("rule_no", "category", "gone"), F.col("rule_no").isNotNull()
    per_text = hits.groupBy("key").agg(
        F.min(F.when(is_rule & F.col("gone").isNull(), rule)).alias("_sure"),
        F.collect_set(F.when(is_rule & F.col("gone").isNotNull(), rule)).alias("_maybe"),
        F.collect_set(F.when(~is_rule, F.col("word"))).alias("_words"),
    )
    kept = F.filter("_maybe", lambda r: ~F.arrays_overlap(r["gone"], F.col("_words")))
    first = F.array_min(F.array_compact(F.concat(kept, F.array("_sure"))))
    return per_text.select("key", first["category"].alias("named"))
