"""Token counts per document without token ids.

Method: pre-tokens here are the words between ASCII white space. A chunk of documents turns its texts into frequencies of its
distinct pre-tokens; the distinct pre-tokens of all chunks meet in buckets by hash, where each is given to the tokenizer once;
the numbers of pieces go back to the chunks and are summed with the frequencies. No ids of a text are ever made.

This is exact for a tokenizer that drops white space and merges nothing across it, which is tested on probes before use.
Distinct pre-tokens of a chunk are told apart by 64-bit hashes.

Defined results: a null or empty text has no bytes and no tokens; special strings within a text are what the tokenizer's own
default makes of them; each row gives a row, also rows of the same id; rows without an id are left out; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.kernels import Words, slices
from tallyflow.llm.rendezvous import MESSAGES, answer, bound_batches, bucket_runs, messages, note, pieces

CHUNK_TEXT = 16 << 20
SCHEMA = "doc_id long, n_bytes long, n_tokens long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_PROBES = ("a b", "it's  Tuesday\n\n3 dogs...", "x\t<|endoftext|> y", "É é ß", "the\x0bend   of", " lead trail ")
_LOADED: dict[int, object] = {}


def _tokenizer(text: str):
    key = hash(text)
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer

        _LOADED[key] = Tokenizer.from_str(text)
        _LOADED[key].no_truncation()
        _LOADED[key].no_padding()
    return _LOADED[key]


def piece_counts(tokenizer, texts: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _frequencies(parts: list[tuple[np.ndarray, Words]]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, their pre-tokens, and for each document in turn its number of distinct
    pre-tokens, their numbers as steps from one to the next, and their frequencies."""
    hashes = [w.hashes() for _, w in parts]
    values, first, at = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    sizes = np.cumsum([0, *(len(h) for h in hashes)])
    tokens: list[bytes] = [b""] * len(values)
    part_of = np.searchsorted(sizes, first, "right") - 1
    for k, (_, words) in enumerate(parts):
        data = words.buf.tobytes()
        mine = np.flatnonzero(part_of == k)
        where = first[mine] - sizes[k]
        for i, s, e in zip(mine.tolist(), words.start[where].tolist(), words.end[where].tolist(), strict=True):
            tokens[i] = data[s:e]
    distinct, steps, times = [], [], []
    for k, (ids, words) in enumerate(parts):
        pairs = (words.doc.astype(np.int64) << 32) | at[sizes[k] : sizes[k + 1]]
        pairs, n = np.unique(pairs, return_counts=True)
        doc, number = pairs >> 32, pairs & 0xFFFFFFFF
        distinct.append(np.bincount(doc, minlength=len(ids)))
        step = np.diff(number, prepend=0)
        head = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
        steps.append(np.where(head, number, step))
        times.append(n)
    return values, tokens, np.concatenate(distinct), np.concatenate(steps), np.concatenate(times)


def _ask(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        parts: list[tuple[np.ndarray, Words]] = []
        size = 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, hi, buf, offsets in slices(batch.column("text")):
                if size + len(buf) > CHUNK_TEXT and parts:
                    yield from _chunk(chunk, parts, n).to_batches()
                    chunk, parts, size = chunk + 1, [], 0
                parts.append((ids[lo:hi].copy(), Words(buf.copy(), offsets)))
                size += len(buf)
        if parts:
            yield from _chunk(chunk, parts, n).to_batches()

    return rows


def _packed(values: np.ndarray) -> bytes:
    """Integers as bytes 0 to 254 or 255 and four bytes more at the end."""
    small = np.minimum(values, 255).astype(np.uint8)
    return small.tobytes() + values[small == 255].astype(np.uint32).tobytes()


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, int]:
    """n packed integers and the bytes they took."""
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = np.frombuffer(data, np.uint8, 4 * len(large), n).copy().view(np.uint32)
    return out, n + 4 * len(large)


def _chunk(chunk: int, parts: list[tuple[np.ndarray, Words]], n: int) -> pa.Table:
    values, tokens, distinct, steps, times = _frequencies(parts)
    ids = np.concatenate([p[0] for p in parts])
    n_bytes = np.concatenate([np.diff(w.offsets) for _, w in parts])
    low, high = (steps & 0xFF).astype(np.uint8), (steps >> 8) + 1
    own = b"".join([
        np.array([len(ids), len(steps), len(values)], np.int64).tobytes(), ids.tobytes(), n_bytes.astype(np.int64).tobytes(), distinct.astype(np.int64).tobytes(),
        low.tobytes(), _packed(high), _packed(times),
    ])
    lengths = np.array([len(t) for t in tokens], np.uint32)
    rows = [(b, np.uint32(e - s).tobytes() + lengths[s:e].tobytes() + b"".join(tokens[s:e])) for b, s, e in bucket_runs(values, n)]
    return messages(chunk, [*rows, (note(chunk), own)])


def _meet(tokenizer_text: str):
    def meet(asked: list[bytes]) -> list[bytes]:
        split: list[list[bytes]] = []
        for m in asked:
            k = int(np.frombuffer(m, np.uint32, 1)[0])
            ends = np.cumsum(np.frombuffer(m, np.uint32, k, 4)) + 4 + 4 * k
            ends = ends.tolist()
            split.append([m[s:e] for s, e in zip([4 + 4 * k, *ends[:-1]], ends, strict=True)])
        distinct = list(dict.fromkeys(t for tokens in split for t in tokens))
        tokenizer, counts = _tokenizer(tokenizer_text), []
        for lo in range(0, len(distinct), 4096):
            counts += piece_counts(tokenizer, [t.decode() for t in distinct[lo : lo + 4096]])
        number = dict(zip(distinct, counts, strict=True))
        return [np.array([number[t] for t in tokens], np.uint32).tobytes() for tokens in split]

    return meet


def _sum(rows: pa.Table) -> pa.Table:
    told = dict(zip(rows.column("bucket").to_pylist(), rows.column("reply").to_pylist(), strict=True))
    own = next(v for b, v in told.items() if b < 0)
    counts = np.concatenate([np.frombuffer(told[b], np.uint32) for b in sorted(told) if b >= 0] or [np.zeros(0, np.uint32)]).astype(np.int64)
    n_docs, n_steps, _ = np.frombuffer(own, np.int64, 3).tolist()
    ids, n_bytes, distinct = np.frombuffer(own, np.int64, 3 * n_docs, 24).reshape(3, n_docs)
    rest = own[24 + 24 * n_docs :]
    low = np.frombuffer(rest, np.uint8, n_steps).astype(np.int64)
    high, used = _unpacked(rest[n_steps:], n_steps)
    times, _ = _unpacked(rest[n_steps + used :], n_steps)
    steps = ((high - 1) << 8) + low
    # steps add up within a document
    ends = np.cumsum(distinct)
    begin = ends - distinct
    total = np.concatenate([[0], np.cumsum(steps)])
    number = total[1:] - np.repeat(total[begin], distinct)
    summed = np.concatenate([[0], np.cumsum(counts[number] * times)])
    return pa.table([pa.array(ids), pa.array(n_bytes), pa.array(summed[ends] - summed[begin])], schema=_SCHEMA)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) with the tokenizer in the JSON file at ``tokenizer_path``, which is read on the driver."""
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    tokenizer = _tokenizer(definition)
    for probe in _PROBES:
        if piece_counts(tokenizer, [probe]) != [sum(piece_counts(tokenizer, probe.split()))]:
            raise ValueError("this tokenizer doesn't treat words between white space by themselves")
    bound_batches(docs.sparkSession)
    n = pieces(docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    # in a fixed order, so that a recomputed task makes the same chunks
    asked = texts.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(_ask(n), MESSAGES)
    return answer(asked, _meet(definition)).groupBy("chunk").applyInArrow(_sum, SCHEMA)
