"""Token ids of documents in files compressed by Re-Pair grammars, with random access.

Writing: documents are dealt by range of id and encoded where they land; every shard, a run of about ``SHARD_TOKENS`` ids, gets a grammar
of its own (``repair``). The format is Parquet, a row for each shard in ascending order of the documents:

    part, shard       place of the shard: number of the range, number within it
    first_doc, last_doc, n_docs
    first_token       ids of the part before the shard
    n_tokens
    doc_ids           64-bit little-endian ids of its documents
    doc_tokens        64-bit little-endian numbers of their ids, the end id included
    grammars          packed grammars; one, or for a longer document one for every ``BLOCK_TOKENS``

Rules never reach over the end of a document. First and last document are in the file's statistics, so that looking for documents reads
only the row groups that hold them; within a shard the expansion lengths tell which symbols hold a range of ids.

Encoding: a text is cut before white space that follows a letter, digit or mark, and before a mark that follows a letter; where a byte-level
tokenizer of this kind ends a pre-token in any case, which is tested on probes first (of one that joins letters and marks, texts are
cut before white space alone). Each distinct piece of a slice is encoded once and kept, up to a bounded number, for the task's
further slices. Pieces of a slice are told apart by 64-bit hashes.

Defined results: a null or empty text has the end id alone; special strings in texts are what the tokenizer's own default makes of them; rows
of the same id all stay, in the order of a hash of their texts; rows without an id are left out; an empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.llm.kernels import SPACE, byte_ranges, slices
from tallyflow.llm.rendezvous import bound_batches, pieces
from tallyflow.llm.repair import Grammar, spans
from tallyflow.llm.token_counts import _tokenizer

SHARD_TOKENS = 1 << 20
BLOCK_TOKENS = 2 << 20
PART_BYTES = 24 << 20
#: Pieces that a task keeps, and ids that they make. Beyond, it begins anew.
KEPT_PIECES, KEPT_IDS = 1 << 20, 1 << 23
SLICE_BYTES = 2 << 20
FORMAT = "part int, shard int, first_doc long, last_doc long, n_docs long, first_token long, n_tokens long, doc_ids binary, doc_tokens binary, grammars array<binary>"
_FORMAT = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.binary()), ("doc_tokens", pa.binary()), ("grammars", pa.list_(pa.binary())),
])
_PROBES = ("a b", "it's  Tuesday\n\n3 dogs...", "x\t<|endoftext|> y", "É é ß    z", "the\x0bend   of", " lead trail ", "12 'll  　x")
#: Marks before which a text may be cut behind a letter. No apostrophe, as it begins endings of words.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
_MARK_PROBES = ("is it, now... Or b.c?", "déjà; né! don't,'tis", "x<|endoftext|>y, a,,b %%% the)")

#: Bytes after which a text may be cut if white space follows: visible ASCII, and the second byte of the two-byte letters from U+00C0 on.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_TWO_BYTES = np.zeros(256, bool)
_TWO_BYTES[0xC3:0xE0] = True


#: Bytes of ASCII letters and of two-byte letters up to U+027F, all but the signs for times and division there.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA), *range(0x80, 0xC0)]] = True
_TWO_BYTE_LETTER = np.zeros(256, bool)
_TWO_BYTE_LETTER[0xC3:0xCA] = True


def _byte_letters() -> np.ndarray:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, np.uint32)
    out[printable] = printable
    rest = [b for b in range(256) if b not in printable]
    out[rest] = 0x100 + np.arange(len(rest))
    return out


_BYTE_LETTERS = _byte_letters()


def _cuts(buf: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Places where pieces begin: those of the documents, white space behind bytes that are none, and marks behind letters."""
    at = np.zeros(len(buf) + 1, bool)
    if len(buf) > 1:
        safe = _VISIBLE[buf[:-1]]
        safe[1:] |= _TWO_BYTES[buf[:-2]]
        at[1:-1] = SPACE[buf[1:]] & safe
        mark = np.flatnonzero(marks[buf[1:]]) + 1
        one, two = buf[mark - 1], buf[np.maximum(mark - 2, 0)]
        sign = (two == 0xC3) & ((one == 0x97) | (one == 0xB7))
        at[mark] |= _LETTER[one] & ((one < 0x80) | (_TWO_BYTE_LETTER[two] & ~sign))
    at[offsets] = True
    at[-1] = False
    return np.flatnonzero(at)


class Numbers:
    """Numbers above 0 by distinct 64-bit hashes, all looked up at once: a table in which a hash that finds its place taken goes to the next."""

    def __init__(self, bits: int = 16) -> None:
        self.count, self.shift, self.mask = 0, np.uint64(64 - bits), (1 << bits) - 1
        self.hashes, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers, 0 for hashes that have none."""
        at = self._places(hashes)
        found = self.numbers[at]
        left = np.flatnonzero((found > 0) & (self.hashes[at] != hashes))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            found[left] = self.numbers[at]
            other = (found[left] > 0) & (self.hashes[at] != hashes[left])
            left, at = left[other], at[other]
        return found

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Take distinct hashes that have no number so far. At most half of the places are taken."""
        if 2 * (self.count + len(hashes)) > len(self.hashes):
            held = np.flatnonzero(self.numbers)
            hashes, numbers = np.concatenate([self.hashes[held], hashes]), np.concatenate([self.numbers[held], numbers])
            self.__init__((4 * len(hashes)).bit_length())
        self.count += len(hashes)
        at, left = self._places(hashes), np.arange(len(hashes))
        while len(left):
            free = left[self.numbers[at[left]] == 0]
            self.numbers[at[free]] = numbers[free]  # one of those that meet in a place gets it
            got = free[self.numbers[at[free]] == numbers[free]]
            self.hashes[at[got]] = hashes[got]
            left = left[self.hashes[at[left]] != hashes[left]]
            at[left] = (at[left] + 1) & self.mask


class Encoder:
    """Ids of slices of documents, with the end id behind each document.

    New pieces of a blank and letters are one pre-token each and go to the tokenizer's model as such. Other new pieces that begin
    with white space and end without are encoded as one text: the tokenizer parts them itself. In both, the bytes that
    each id stands for tell where a piece ends. What is left is encoded one by one.
    """

    def __init__(self, tokenizer, end_id: int, marks: bytes = _MARKS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = tokenizer, end_id
        own = {b for t in tokenizer.get_added_tokens_decoder().values() for b in t.content.encode()}
        self.marks = np.zeros(256, bool)
        self.marks[[b for b in marks if b not in own]] = True  # no special string is cut
        self.model = Tokenizer(tokenizer.model)
        special = {i: len(t.content.encode()) for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.id_bytes = np.zeros(max(tokenizer.get_vocab_size(with_added_tokens=True), 1), np.int64)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            self.id_bytes[i] = special.get(i, len(token))  # a letter of a byte-level token is a byte
        self._forget()

    def _forget(self) -> None:
        self.number = Numbers()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 1
        self.flat[0] = self.end_id  # piece 0
        self.starts, self.sizes = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Add the pieces buf[start:end]; their numbers."""
        data = buf.tobytes()
        other = ~_LETTER[buf]
        other[1:] |= (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))
        others = np.concatenate([[0], np.cumsum(other)])
        word = (buf[start] == 0x20) & (end - start > 1) & (others[end] == others[start + 1])
        last = buf[end - 1]
        free = ~word & SPACE[buf[start]] & (_VISIBLE[last] | (_TWO_BYTES[buf[np.maximum(end - 2, 0)]] & (end - start > 2)))
        ids, sizes = [], np.zeros(len(start), np.int64)
        words, together, alone = np.flatnonzero(word), np.flatnonzero(free), np.flatnonzero(~word & ~free)

        def parted(some: np.ndarray, got: list[int]) -> None:
            """Take the ids of some pieces, told apart by their bytes."""
            ids.append(np.array(got, np.int32))
            ends = np.searchsorted(np.cumsum(self.id_bytes[ids[-1]]), np.cumsum(end[some] - start[some])) + 1
            sizes[some] = np.diff(ends, prepend=0)

        if len(words):
            size = end[words] - start[words]
            letters = _BYTE_LETTERS[buf[spans(start[words], size)]].tobytes().decode("utf-32-le")
            ends = np.cumsum(size).tolist()
            own = [letters[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
            parted(words, self.model.encode_batch_fast([own], is_pretokenized=True, add_special_tokens=False)[0].ids)
        if len(together):
            text = b"".join([data[s:e] for s, e in zip(start[together].tolist(), end[together].tolist(), strict=True)])
            parted(together, self._encode([text.decode()])[0])
        if len(alone):
            got = self._encode([data[s:e].decode() for s, e in zip(start[alone].tolist(), end[alone].tolist(), strict=True)])
            sizes[alone] = [len(x) for x in got]
            ids.append(np.array([i for x in got for i in x], np.int32))
        order = np.concatenate([words, together, alone])
        made = np.concatenate(ids)
        if self.used + len(made) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(made), np.int32)])
        self.flat[self.used : self.used + len(made)] = made
        numbers = np.empty(len(order), np.int32)
        numbers[order] = np.arange(len(self.sizes), len(self.sizes) + len(order))
        self.number.add(hashes, numbers)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes[order]) - sizes[order]])
        self.sizes = np.concatenate([self.sizes, sizes[order]])
        self.used += len(made)
        return numbers

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each document has."""
        start = _cuts(buf, offsets, self.marks)
        end = np.append(start[1:], len(buf)) if len(start) else start
        first = np.searchsorted(start, offsets)  # the first piece of each document
        hashes = byte_ranges(buf)(start, end)
        numbers = self.number.find(hashes)
        missing = np.flatnonzero(numbers == 0)
        if len(missing):
            new, pick, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            if self.number.count + len(new) > KEPT_PIECES or self.used > KEPT_IDS:
                self._forget()
                missing = np.arange(len(hashes))
                new, pick, which = np.unique(hashes, return_index=True, return_inverse=True)
            at = missing[pick]
            numbers[missing] = self._learn(new, buf, start[at], end[at])[which]
        held = np.insert(numbers, first[1:], 0)  # the end id behind each document
        sizes = self.sizes[held]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[spans(self.starts[held], sizes)], np.diff(sums[first + np.arange(len(first))])


def _shard(part: int, shard: int, first_token: int, ids: list[int], tokens: np.ndarray, sizes: np.ndarray, alphabet: int, block: int) -> pa.RecordBatch:
    last = np.zeros(len(tokens), bool)
    last[np.cumsum(sizes) - 1] = True
    grammars = [Grammar.of(tokens[lo : lo + block], last[lo : lo + block], alphabet).pack() for lo in range(0, len(tokens), block)]
    row = [part, shard, ids[0], ids[-1], len(ids), first_token, len(tokens), np.array(ids, "<i8").tobytes(), sizes.astype("<i8").tobytes(), grammars]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _FORMAT, strict=True)], schema=_FORMAT)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the ids of all texts to ``path``. The tokenizer's JSON file is read on the driver."""
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    tokenizer = _tokenizer(definition)

    def fits(marks: bytes, probes: tuple[str, ...]) -> bool:
        encode = Encoder(tokenizer, end_id, marks)
        return all(encode(np.frombuffer(p.encode(), np.uint8), np.array([0, len(p.encode())]))[0][:-1].tolist() == tokenizer.encode(p, add_special_tokens=False).ids for p in probes)

    if not fits(b"", _PROBES):
        raise ValueError("this tokenizer joins what lies on both sides of white space")
    marks = _MARKS if fits(_MARKS, (*_PROBES, *_MARK_PROBES)) else b""
    alphabet = max(tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    given = docs.sparkSession.sparkContext.broadcast(definition)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = Encoder(_tokenizer(given.value), end_id, marks), TaskContext.get().partitionId()
        shard, before, ids, tokens, sizes, n = 0, 0, [], [], [], 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for lo, hi, buf, offsets in slices(batch.column("text"), SLICE_BYTES):
                own, own_sizes = encode(buf, offsets)
                ids += names[lo:hi]
                tokens.append(own)
                sizes.append(own_sizes)
                n += len(own)
                if n >= shard_tokens:
                    yield _shard(part, shard, before, ids, np.concatenate(tokens), np.concatenate(sizes), alphabet, block_tokens)
                    shard, before, ids, tokens, sizes, n = shard + 1, before + n, [], [], [], 0
        if ids:
            yield _shard(part, shard, before, ids, np.concatenate(tokens), np.concatenate(sizes), alphabet, block_tokens)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    keys = ["doc_id", F.xxhash64("text"), "_salt"]  # the salt parts rows that are equal otherwise
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(pieces(docs, PART_BYTES), *keys).sortWithinPartitions(*keys)
    dealt.select("doc_id", "text").mapInArrow(run, FORMAT).write.option("compression", "zstd").parquet(path)


def part_starts(shards: DataFrame) -> DataFrame:
    """(part, part_start): ids of all parts before. Sums of sums, so that no task sees the rows of all parts."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("part") / 1024))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier(Window.orderBy("block"))), F.lit(0)))
    within = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("block").orderBy("part"))), F.lit(0))
    return parts.withColumn("within", within).join(blocks.select("block", "before"), "block").select("part", (F.col("before") + F.col("within")).alias("part_start"))


def _documents(batch: pa.RecordBatch, wanted: set | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(part, place in the part, id, ids) of the documents of a batch of shards; of the wanted ones, if there are such, and
    no other symbols are expanded then."""
    columns = [batch.column(c).to_pylist() for c in ("part", "first_token", "doc_ids", "doc_tokens")]
    for k, (part, first, doc_ids, doc_tokens) in enumerate(zip(*columns, strict=True)):
        names, ends = np.frombuffer(doc_ids, "<i8").tolist(), np.cumsum(np.frombuffer(doc_tokens, "<i8"))
        grammars = [Grammar.unpack(g) for g in batch.column("grammars")[k].as_py()]
        whole = None if wanted is not None else np.concatenate([g.ids() for g in grammars])
        bounds = np.cumsum([0, *(g.n_ids() for g in grammars)]).tolist()
        for name, lo, hi in zip(names, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if whole is not None:
                yield part, first + lo, name, whole[lo:hi]
            elif name in wanted:
                own = [g.ids(max(lo - at, 0), hi - at) for g, at in zip(grammars, bounds[:-1], strict=True) if at < hi and lo < at + g.n_ids()]
                yield part, first + lo, name, np.concatenate(own)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents of the files, ``start`` being the ids of all documents before."""
    shards = spark.read.schema(FORMAT).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = [(p, at, name, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for p, at, name, ids in _documents(batch.slice(k, 1))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 4), strict=True)], names=["part", "at", "doc_id", "n_tokens", "ids_crc32"])

    read = shards.select("part", "first_token", "doc_ids", "doc_tokens", "grammars").mapInArrow(run, "part int, at long, doc_id long, n_tokens long, ids_crc32 long")
    return read.join(part_starts(shards), "part").select("doc_id", (F.col("at") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents. Shards without them are not read, and of the others only the symbols that hold them are expanded."""
    wanted = sorted(set(doc_ids))
    shards = spark.read.schema(FORMAT).parquet(path)
    holds = F.lit(False)
    for name in wanted:
        holds = holds | ((F.col("first_doc") <= name) & (F.col("last_doc") >= name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, ids.tolist()) for _, _, name, ids in _documents(batch, set(wanted))]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return shards.where(holds).select("part", "first_token", "doc_ids", "doc_tokens", "grammars").mapInArrow(run, "doc_id long, ids array<int>")
