"""Substring dedup: words of long passages that a document with a smaller id holds too.

Method: difference-cover anchors. A set D modulo p is a difference cover if every difference modulo p is one of two members;
{1, 2, 4} modulo 7 is one. So for any two places i and j some step t < p brings both to positions in D. Only runs of
``window - p + 1`` words that start at positions in D are hashed; two equal windows, wherever they start, hold such an anchor
at the same step. Anchors that two documents share are extended to the windows around them, and only these windows are compared.

Two rounds of questions through hash buckets (see ``rendezvous``): which anchors do two documents hold; for which windows
does a smaller document hold the same one. Windows are equal if their 64-bit hashes (and buckets, which add bits of the
same hash as the data grow) are: by accident one in 10**19 pairs.

Defined results: a null text is empty; empty texts and texts shorter than a window lose nothing; rows of the same id are
separate texts of one document, which never remove each other's words; rows without an id are left out; other columns are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyflow.llm.kernels import Words, any_ahead, covered, mix, runs, slices, texts_of
from tallyflow.llm.rendezvous import answer, ask, bucket_runs, chunked, conclude, in_order, note, pieces

WINDOW = 13
PERIOD = 7
SCHEMA = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
    ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string()),
])


def difference_cover(period: int) -> list[int]:
    """Members of a small difference cover modulo ``period``: each step adds what covers the most new differences."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gain = {c: {(c - x) % period for x in cover} | {(x - c) % period for x in cover} for c in range(period) if c not in cover}
        best = max(gain, key=lambda c: (len(gain[c] & missing), -c))
        cover.append(best)
        missing -= gain[best]
    return sorted(cover)


def _anchors(words: Words, size: int, period: int, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the slice and hashes of the runs of ``size`` words at cover positions of their document."""
    whole = words.one_document(size)
    place = np.arange(len(whole)) - words.first[words.doc[: len(whole)]]
    at = np.flatnonzero(whole & cover[place % period])
    return at, words.ranges()(at, at + size)


def _parts(rows: pa.Table):
    """(document ids, words) of the slices of a chunk, in an order that is the same in every round."""
    rows = rows.sort_by("doc_id")
    ids = rows.column("doc_id").to_numpy()
    for lo, hi, buf, offsets in slices(rows.column("text")):
        yield ids[lo:hi], Words(buf, offsets)


def _shared_within(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the smallest document of each, and whether a second document has it."""
    order = np.lexsort((docs, values))
    values, docs = values[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    low = docs[first]
    high = docs[np.concatenate([first[1:], [len(docs)]]) - 1] if len(values) else low
    return values[first], low, high > low


def _meet_anchors(asked: list[bytes]) -> list[bytes]:
    """Which anchors of each message another message or a second document of the same chunk holds."""
    split = [np.frombuffer(m, np.uint8) for m in asked]
    sizes = [int(np.frombuffer(m, np.uint32, 1)[0]) for m in asked]
    values = np.concatenate([m[4 : 4 + 4 * k].view(np.uint32) for m, k in zip(split, sizes, strict=True)])
    flags = np.concatenate([np.unpackbits(m[4 + 4 * k :], count=k) for m, k in zip(split, sizes, strict=True)]).astype(bool)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    repeated = np.zeros(len(values), bool)
    repeated[order[1:]] |= same
    repeated[order[:-1]] |= same
    repeated |= flags
    ends = np.cumsum(sizes)
    return [np.packbits(repeated[e - k : e]).tobytes() for e, k in zip(ends, sizes, strict=True)]


def _meet_windows(asked: list[bytes]) -> list[bytes]:
    """For which windows of each message another message has a smaller document."""
    pairs = [np.frombuffer(m, np.uint64).reshape(2, -1) for m in asked]
    values = np.concatenate([p[0] for p in pairs])
    docs = np.concatenate([p[1] for p in pairs]).view(np.int64)
    order = np.lexsort((docs, values))
    ranked = values[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    least = docs[order][np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
    smaller = np.zeros(len(values), bool)
    smaller[order] = least < docs[order]
    ends = np.cumsum([p.shape[1] for p in pairs])
    return [np.packbits(smaller[e - p.shape[1] : e]).tobytes() for e, p in zip(ends, pairs, strict=True)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text): ``removed`` are runs of word numbers, ``kept_text`` the other words
    joined by one space. A word goes if a window of ``window`` words over it also starts in a document with a smaller id."""
    if not 1 <= period <= window:
        raise ValueError("period must be from 1 to window")
    size = window - period + 1
    cover = np.zeros(period, bool)
    cover[difference_cover(period)] = True
    n = pieces(docs)
    chunks = chunked(docs, id_col, text_col, n)

    def anchors(rows: pa.Table) -> list[tuple[int, bytes]]:
        found = [(h, ids[words.doc[at]]) for ids, words in _parts(rows) for at, h in [_anchors(words, size, period, cover)]]
        values, _, shared = _shared_within(*map(np.concatenate, zip(*found, strict=True)))
        low = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return [(b, np.uint32(e - s).tobytes() + low[s:e].tobytes() + np.packbits(shared[s:e]).tobytes()) for b, s, e in bucket_runs(values, n)]

    def windows(rows: pa.Table, told: dict[int, bytes]) -> list[tuple[int, bytes]]:
        parts = [(ids, words, *_anchors(words, size, period, cover)) for ids, words in _parts(rows)]
        values = np.unique(np.concatenate([p[3] for p in parts]))
        shared = np.concatenate([np.unpackbits(np.frombuffer(told[b], np.uint8), count=e - s) for b, s, e in bucket_runs(values, n)] or [np.zeros(0, np.uint8)])
        notes, found = [], []
        for ids, words, at, hashes in parts:
            flags = np.zeros(len(words), bool)
            flags[at] = shared[np.searchsorted(values, hashes)]
            candidate = np.zeros(len(words), bool)
            whole = words.one_document(window)
            candidate[: len(whole)] = any_ahead(flags, period)[: len(whole)] & whole
            notes.append(candidate)
            where = np.flatnonzero(candidate)
            found.append((words.ranges()(where, where + window), ids[words.doc[where]]))
        values, least, _ = _shared_within(*map(np.concatenate, zip(*found, strict=True)))
        out = [(b, values[s:e].tobytes() + least[s:e].tobytes()) for b, s, e in bucket_runs(values, n)]
        return [*out, (note(rows.column("chunk")[0].as_py()), np.packbits(np.concatenate(notes)).tobytes())]

    def result(rows: pa.Table, told: dict[int, bytes]) -> pa.Table:
        candidates = np.unpackbits(np.frombuffer(next(v for b, v in told.items() if b < 0), np.uint8)).astype(bool)
        parts, found, at = [], [], 0
        for ids, words in _parts(rows):
            where = np.flatnonzero(candidates[at : at + len(words)])
            at += len(words)
            parts.append((ids, words, where))
            found.append((words.ranges()(where, where + window), ids[words.doc[where]]))
        values, least, _ = _shared_within(*map(np.concatenate, zip(*found, strict=True)))
        replies = dict(zip(sorted(b for b in told if b >= 0), in_order(told), strict=True))
        smaller = np.concatenate([np.unpackbits(np.frombuffer(replies[b], np.uint8), count=e - s) for b, s, e in bucket_runs(values, n)] or [np.zeros(0, np.uint8)]).astype(bool)
        columns: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "removed": [], "kept_text": []}
        for (ids, words, where), (hashes, holders) in zip(parts, found, strict=True):
            entry = np.searchsorted(values, hashes)
            start = where[smaller[entry] | (holders > least[entry])]
            gone = covered(start, window, len(words))
            from_, to = runs(gone & np.ones(len(words), bool))
            # a run may go on from one document into the next: cut it there
            cut = words.first[1:-1]
            cut = cut[(cut > 0) & (cut < len(words))]
            cut = np.unique(cut[gone[cut] & gone[cut - 1]]) if len(cut) else cut
            from_, to = np.sort(np.concatenate([from_, cut])), np.sort(np.concatenate([to, cut]))
            begin, end = np.searchsorted(from_, words.first[:-1]), np.searchsorted(from_, words.first[1:])
            data = words.buf.tobytes()
            for k, doc in enumerate(ids.tolist()):
                a, b = int(words.first[k]), int(words.first[k + 1])
                own = data[words.offsets[k] : words.offsets[k + 1]].split()
                spans = list(zip((from_[begin[k] : end[k]] - a).tolist(), (to[begin[k] : end[k]] - a).tolist(), strict=True))
                if spans:
                    own = compress(own, (~gone[a:b]).tolist())
                columns["doc_id"].append(doc)
                columns["n_words"].append(b - a)
                columns["n_removed"].append(sum(e - s for s, e in spans))
                columns["removed"].append([{"start": s, "end": e} for s, e in spans])
                columns["kept_text"].append(b" ".join(own))
        columns["kept_text"] = pa.array(columns["kept_text"], pa.binary()).cast(pa.string())
        return pa.table([pa.array(columns[f.name], f.type) if f.name != "kept_text" else columns[f.name] for f in _SCHEMA], schema=_SCHEMA)

    shared = answer(ask(chunks, anchors), _meet_anchors)
    smaller = answer(ask(chunks, windows, shared), _meet_windows)
    return conclude(chunks, smaller, result, SCHEMA)
