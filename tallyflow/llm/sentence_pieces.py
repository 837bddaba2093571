"""SentencePiece encoding and decoding: the best unigram path over a double-array trie of pieces.

A text gets a blank in front; blanks stand for the whitespace marker of the pieces. The path with the highest sum of log scores is
found by Viterbi's method, for all distinct words of a slice at once: a column of the lattice per byte, walked along the trie together.
A character without a piece of its own may be written as its bytes, at the least score of all pieces less 10. Of equal
paths the one with the longest last piece wins, as in the public library. Pieces with the marker behind other characters don't exist
in the model, so words that begin with a run of blanks are encoded by themselves.

Decoding puts the pieces' and bytes' texts together and takes off the first blank: every text comes back exactly, the marker
character itself too, since it is written as bytes.

The model file is read on the driver; its tables, a few hundred kilobytes, are broadcast.

Defined results: null and empty texts have no pieces and come back as null and empty; every row gives a row; other columns are kept, and a
column with the name of the result is replaced.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tallyflow.llm.kernels import byte_ranges, slices
from tallyflow.llm.rendezvous import bound_batches

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Longer words are walked one by one, as a matrix of them would be large.
MATRIX_BYTES = 64
_SLICE = 1 << 20


@dataclass
class DoubleArray:
    """A trie of byte strings: the child of node s by byte c is base[s] + c if check there is s. ``value`` is -1 where no key ends."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    longest: int


def double_array(keys: dict[bytes, int]) -> DoubleArray:
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for key, value in sorted(keys.items()):
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][c]
        ends[node] = value
    size = 4 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0], check[0], value[0] = False, 0, ends[0]
    begin = [1] * 257  # where nodes of so many children found room last
    queue = deque([(0, 0)])
    while queue:
        node, slot = queue.popleft()
        if not children[node]:
            continue
        labels = sorted(children[node])
        at = max(begin[len(labels)] - labels[0], 1)
        while True:  # the first place where the slots of all labels are free
            fits = np.logical_and.reduce([free[at + c : at + c + 512] for c in labels])
            if fits.any():
                at += int(fits.argmax())
                break
            at += 512
        base[slot] = at
        begin[len(labels)] = at + labels[0]
        for c in labels:
            free[at + c], check[at + c], value[at + c] = False, slot, ends[children[node][c]]
            queue.append((children[node][c], at + c))
    used = int(np.flatnonzero(~free)[-1]) + 257
    return DoubleArray(base[:used], check[:used], value[:used], max(map(len, keys), default=0))


class PieceModel:
    """Pieces of a model file with their scores."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.texts: list[bytes] = [b""] * n
        self.bytes = np.full(256, -1, np.int32)
        keys: dict[bytes, int] = {}
        scores = np.zeros(n)
        for i in range(n):
            piece = model.id_to_piece(i)
            scores[i] = model.get_score(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.texts[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(MARKER, " ").encode()
                if b" " in text.lstrip(b" "):
                    raise ValueError("a piece holds the whitespace marker behind other characters")
                keys[text] = i
                self.texts[i] = text
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte fallback")
        self.scores = scores
        self.unknown = min(scores[i] for i in keys.values()) - UNKNOWN_PENALTY
        self.trie = double_array(keys)


def _char_sizes(first: np.ndarray) -> np.ndarray:
    return 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)


def encode_matrix(words: np.ndarray, sizes: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words in the rows of a byte matrix, from the last piece to the first, and their numbers."""
    n, width = words.shape
    base, check, value = model.trie.base, model.trie.check, model.trie.value
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    piece, back = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int16)
    for s in range(width):
        rows = np.flatnonzero((s < sizes) & ((words[:, s] & 0xC0) != 0x80))
        if not len(rows):
            continue
        here = best[rows, s]
        size = _char_sizes(words[rows, s])
        alone = np.zeros(n, bool)
        live, state, score = rows, np.zeros(len(rows), np.int32), here
        chars = size
        for e in range(s, min(s + model.trie.longest, width)):
            inside = e < sizes[live]
            slot = base[state] + words[live, e]
            inside &= check[slot] == state
            live, state, score, chars = live[inside], slot[inside], score[inside], chars[inside]
            if not len(live):
                break
            number = value[state]
            ends = number >= 0
            to = live[ends]
            total = score[ends] + model.scores[number[ends]]
            better = total > best[to, e + 1]
            to = to[better]
            best[to, e + 1], piece[to, e + 1], back[to, e + 1] = total[better], number[ends][better], s
            alone[live[ends & (chars == e + 1 - s)]] = True
        # a character without a piece: its bytes, the score counted with the last one
        lone = ~alone[rows]
        rows, here, size = rows[lone], here[lone] + model.unknown, size[lone]
        for k in range(int(size.max(initial=0))):
            to, total, last = rows[size > k], here[size > k], size[size > k] == k + 1
            better = ~last | (total > best[to, s + k + 1])
            to = to[better]
            best[to, s + k + 1], piece[to, s + k + 1], back[to, s + k + 1] = total[better], model.bytes[words[to, s + k]], s + k
    out, count = np.zeros((n, width), np.int32), np.zeros(n, np.int64)
    at, rows = sizes.copy(), np.flatnonzero(sizes > 0)
    while len(rows):
        out[rows, count[rows]] = piece[rows, at[rows]]
        at[rows] = back[rows, at[rows]]
        count[rows] += 1
        rows = rows[at[rows] > 0]
    return out, count


def encode_word(word: bytes, model: PieceModel) -> list[int]:
    """Ids of one word."""
    n = len(word)
    base, check, value, scores = model.lists
    best, piece, back = [-np.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for s in range(n):
        first = word[s]
        if first & 0xC0 == 0x80:
            continue
        here, state, alone = best[s], 0, False
        size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
        for e in range(s, min(s + model.trie.longest, n)):
            slot = base[state] + word[e]
            if check[slot] != state:
                break
            state = slot
            number = value[state]
            if number >= 0:
                alone |= e + 1 - s == size
                total = here + scores[number]
                if total > best[e + 1]:
                    best[e + 1], piece[e + 1], back[e + 1] = total, number, s
        if not alone:
            for k in range(size):
                if k + 1 < size or here + model.unknown > best[s + k + 1]:
                    best[s + k + 1], piece[s + k + 1], back[s + k + 1] = here + model.unknown, int(model.bytes[word[s + k]]), s + k
    out, at = [], n
    while at:
        out.append(piece[at])
        at = back[at]
    return out[::-1]


def _split(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a blank in front as one buffer; starts and ends of their words, and the first word of each document."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    data = np.insert(buf, offsets[full], 32)
    shift = np.zeros(len(offsets), np.int64)
    shift[1:] = np.cumsum(np.diff(offsets) > 0)
    offsets = offsets + shift
    blank = data == 32
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(start)
    return data, start, np.append(start[1:], len(data)), np.searchsorted(start, offsets)


def encode_slice(buf: np.ndarray, offsets: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a slice in turn, and the offsets of the documents in them."""
    data, start, end, first = _split(buf, offsets)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    _, pick, which = np.unique(byte_ranges(data)(start, end), return_index=True, return_inverse=True)
    begin, size = start[pick], (end - start)[pick]
    count = np.zeros(len(pick), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # words, and their ids in turn
    limits = [0, 4, 6, 8, 10, 12, 16, 24, 32, MATRIX_BYTES]
    for low, high in zip(limits[:-1], limits[1:], strict=True):
        some = np.flatnonzero((size > low) & (size <= high))
        for lo in range(0, len(some), 16384):
            words = some[lo : lo + 16384]
            place = begin[words, None] + np.arange(high)
            matrix = data[np.minimum(place, len(data) - 1)]
            ids, n = encode_matrix(matrix, size[words], model)
            count[words] = n
            turn = n[:, None] - 1 - np.arange(int(n.max()))
            rows, places = np.nonzero(turn >= 0)
            parts.append((words, ids[rows, turn[rows, places]]))
    for word in np.flatnonzero(size > MATRIX_BYTES).tolist():
        ids = encode_word(data[begin[word] : begin[word] + size[word]].tobytes(), model)
        count[word] = len(ids)
        parts.append((np.array([word]), np.array(ids, np.int32)))
    words = np.concatenate([p[0] for p in parts])
    ids = np.concatenate([p[1] for p in parts])
    ends = np.cumsum(count[words])
    at = np.zeros(len(pick), np.int64)
    at[words] = ends - count[words]
    times = count[which]
    ends = np.concatenate([[0], np.cumsum(times)])
    source = np.repeat(at[which] - ends[:-1], times) + np.arange(ends[-1])
    return ids[source], ends[first]


def decode_ids(ids: np.ndarray, offsets: np.ndarray, joined: np.ndarray, where: np.ndarray) -> list[bytes]:
    """Texts of documents of ids; ``joined`` holds the pieces' texts in turn and ``where`` their offsets."""
    size = np.diff(where)[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = joined[np.repeat(where[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    return [data[s + 1 : e] if e > s else b"" for s, e in zip(ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist(), strict=True)]


def _replaced(df: DataFrame, name: str, kind) -> StructType:
    return StructType([*(f for f in df.schema.fields if f.name != name), StructField(name, kind)])


def _with_column(batch: pa.RecordBatch, lo: int, hi: int, names: list[str], column: pa.Array) -> pa.RecordBatch:
    kept = [batch.column(i).slice(lo, hi - lo) for i, n in enumerate(batch.schema.names) if n in names[:-1]]
    return pa.RecordBatch.from_arrays([*kept, column], names=names)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """``docs`` with the piece ids of the texts."""
    bound_batches(docs.sparkSession)
    model = PieceModel(model_path)
    t = model.trie
    model.lists = (t.base.tolist(), t.check.tolist(), t.value.tolist(), model.scores.tolist())
    given = docs.sparkSession.sparkContext.broadcast(model)
    schema = _replaced(docs, ids_col, ArrayType(IntegerType()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi, buf, offsets in slices(texts, _SLICE):
                ids, at = encode_slice(buf, offsets, given.value)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), mask=texts.slice(lo, hi - lo).is_null())
                yield _with_column(batch, lo, hi, names, lists)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the texts of the piece ids."""
    texts = PieceModel(model_path).texts
    tables = (np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
    given = encoded.sparkSession.sparkContext.broadcast(tables)
    schema = _replaced(encoded, text_col, StringType())
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, where = given.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            for lo in range(0, batch.num_rows, 256):
                some = lists.slice(lo, 256)
                sizes = some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                out = decode_ids(some.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), joined, where)
                column = pa.array(out, pa.binary(), mask=some.is_null().to_numpy(zero_copy_only=False)).cast(pa.string())
                yield _with_column(batch, lo, min(lo + 256, batch.num_rows), names, column)

    return encoded.mapInArrow(run, schema)


def byte_piece_ids(model_path: str) -> list[int]:
    """Ids of the pieces that stand for single bytes."""
    return PieceModel(model_path).bytes.tolist()


def piece_numbers(ids_col: str, byte_ids: list[int]) -> list:
    """Columns n_pieces and n_byte_pieces."""
    low, high = min(byte_ids), max(byte_ids)
    if sorted(byte_ids) != list(range(low, high + 1)):
        raise ValueError("byte pieces aren't in one run of ids")
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    return [F.size(ids).cast("long").alias("n_pieces"), F.size(F.filter(ids, lambda i: i.between(low, high))).cast("long").alias("n_byte_pieces")]
