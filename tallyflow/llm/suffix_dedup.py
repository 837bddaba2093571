"""Suffix-array dedup: bytes of 400-byte strings that start anywhere else, in the same document or another.

A suffix array of a whole corpus neither fits a task nor is needed: only strings that occur twice matter. So:

1. The least hash of the 337 64-byte grams of a 400-byte string marks its anchor. The choice depends on the string alone, so equal
   strings have their anchor at the same offset. Anchors whose gram occurs once in the corpus end here.
2. The strings of one anchor overlap; the text they span is its fragment, at most 736 bytes. Distinct fragments of shared anchors
   meet in buckets by gram. There the suffixes that begin at the anchors are sorted by linear grouping (``suffix_groups``) and
   cut into classes wherever neighbours share too few bytes; the reversed left contexts likewise. Two strings are
   equal exactly if their anchor's offset, right class and left class are.
3. Each document drops the bytes under its repeated strings.

Comparisons are of bytes; hashes only choose what is compared. A passage held by a third of all documents is one fragment per chunk.

A gram may also be hot: a line shorter than the strings, or the end of a passage, that stands in very many documents with
different text around it has as many different fragments. Fragments of a gram are counted before they are sent, and those of a gram
with more than ``HOT`` are not sent at all: their strings go instead, one by one, each as two 64-bit hashes of all its bytes, dealt by
these, once for every chunk. So no task meets more than ``HOT`` fragments of a gram or more than one entry of a chunk for a
string, whatever is frequent. Only for these strings equality is that of 128 bits of hashes.

Defined results: a null text is empty; texts shorter than the length lose nothing; rows of the same id are separate texts, and their
common strings count as repeated; rows without an id are left out; other columns are not read. What remains
may be cut within a character, so it is returned as bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyflow.llm.kernels import Ranges, U, byte_ranges, mix, runs, slices
from tallyflow.llm.rendezvous import answer, ask, bucket_runs, chunked, conclude, note, pieces
from tallyflow.llm.suffix_groups import common_prefixes, row_order

LENGTH = 400
GRAM = 64
#: Fragments sorted together; those of one gram always are.
AT_ONCE = 4096
#: Symbols into which a side of a fragment is cut for sorting.
SYMBOLS = 8
#: Fragments of a gram, distinct ones of every chunk added up, beyond which its strings are compared by hash.
HOT = 4096
_MOST = 0xFFFF
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<start:int,end:int>>, kept binary"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("removed", pa.list_(_SPAN)), ("kept", pa.binary()),
])
#: An anchor of a chunk: its document, its place in it, the first and last start of the strings it marks, the hash of its gram.
ANCHOR = np.dtype([("doc", "<i4"), ("at", "<i4"), ("first", "<i4"), ("last", "<i4"), ("gram", "<u8")])
#: A fragment: hash of its gram, bytes left of the anchor, starts beyond the first, whether the chunk holds it twice.
FRAGMENT = np.dtype([("gram", "<u8"), ("left", "<u2"), ("more", "<u2"), ("twice", "<u2")])


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """min(values[i : i + size]) for every i that has so many, by minima from the ends of blocks of ``size``."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // size) * size, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return np.minimum(ahead[:n], behind[size - 1 : size - 1 + n])


def find_anchors(buf: np.ndarray, offsets: np.ndarray, doc: int, length: int, gram: int) -> np.ndarray:
    """Anchors of all strings of ``length`` bytes of the documents; ``doc`` is the number of the first one."""
    inside = np.diff(offsets) >= length
    if not inside.any():
        return np.zeros(0, ANCHOR)
    hashes = byte_ranges(buf).windows(gram)
    # 32 bits of the hash, then the place from the end: of equal hashes the last one is the anchor
    keys = (hashes & U(0xFFFFFFFF00000000)) | (U(0xFFFFFFFF) - np.arange(len(hashes), dtype=U))
    owner = (U(0xFFFFFFFF) - (sliding_least(keys, length - gram + 1) & U(0xFFFFFFFF))).astype(np.int64)
    counts = np.where(inside, np.diff(offsets) - length + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(counts.sum()) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    owner = owner[starts]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (docs[1:] != docs[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(owner)]]) - 1
    out = np.zeros(len(first), ANCHOR)
    base = offsets[docs[first]]
    out["doc"], out["at"] = docs[first] + doc, owner[first] - base
    out["first"], out["last"] = starts[first] - base, starts[last] - base
    out["gram"] = mix(hashes[owner[first]])  # least hashes are small, and buckets go by size
    return out


GRAM_ENTRY = np.dtype([("gram", "<u8"), ("twice", "<u2"), ("fragments", "<u2")])


def _meet_grams(asked: list[bytes], hot: int) -> list[bytes]:
    """Which grams of each message occur twice, and which have more than ``hot`` fragments."""
    entries = [np.frombuffer(m, GRAM_ENTRY) for m in asked]
    values = np.concatenate(entries)
    _, at, times = np.unique(values["gram"], return_inverse=True, return_counts=True)
    twice = (times[at] > 1) | (values["twice"] > 0)
    many = np.bincount(at, values["fragments"])[at] > hot
    ends = np.cumsum([len(e) for e in entries])
    return [np.packbits(twice[t - len(e) : t]).tobytes() + np.packbits(many[t - len(e) : t]).tobytes() for e, t in zip(entries, ends, strict=True)]


def _flags(reply: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(reply, np.uint8).reshape(2, -1)
    return np.unpackbits(both[0], count=n).astype(bool), np.unpackbits(both[1], count=n).astype(bool)


_OTHER_VALUES = mix(np.arange(0x1001, 0x1101, dtype=U))
_OTHER_BASE = 0xA0761D6478BD642F


def _string_hashes(buf: np.ndarray, length: int) -> np.ndarray:
    """Two independent hashes of the string of ``length`` bytes at every place that has one; the second one's lowest bit is 0."""
    pair = np.empty((max(len(buf) - length + 1, 0), 2), U)
    pair[:, 0] = byte_ranges(buf).windows(length)
    pair[:, 1] = Ranges(_OTHER_VALUES[buf], _OTHER_BASE).windows(length) & ~U(1)
    return pair


def _meet_strings(asked: list[bytes]) -> list[bytes]:
    """Which strings of each message occur twice; a string is its hashes, the lowest bit says whether the chunk itself holds it twice."""
    entries = [np.frombuffer(m, np.uint64, offset=4).reshape(-1, 2) for m in asked]
    values = np.concatenate(entries)
    _, at, times = np.unique(values & np.array([~U(0), ~U(1)]), axis=0, return_inverse=True, return_counts=True)
    twice = (times[at.reshape(-1)] > 1) | (values[:, 1] & U(1)).astype(bool)
    ends = np.cumsum([len(e) for e in entries])
    return [np.packbits(twice[t - len(e) : t]).tobytes() for e, t in zip(entries, ends, strict=True)]


def repeated_strings(fragments: np.ndarray, start: np.ndarray, texts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each fragment and offset of the anchor, whether the string of that offset occurs twice. ``start`` is where a fragment
    begins in ``texts``; column o of the result stands for the string that starts o bytes left of the anchor."""
    reach = length - gram
    m = len(fragments)
    left, more = fragments["left"].astype(np.int64), fragments["more"].astype(np.int64)
    anchor = start + left

    def context(step: int, width: int, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(width, dtype=np.int32)
        rows = np.empty((m, width), np.uint8)
        for lo in range(0, m, 512):  # index arrays take eight times the room of the bytes
            index = anchor[lo : lo + 512, None] + (place if step > 0 else -1 - place)
            np.clip(index, 0, len(texts) - 1, out=index)
            rows[lo : lo + 512] = np.where(place < count[lo : lo + 512, None], texts[index], np.uint8(0))
        order = row_order(rows, -(-width // SYMBOLS))
        return order, common_prefixes(rows[order])

    right, right_common = context(1, length, more + length - left)
    back, back_common = context(-1, reach, left)
    out = np.zeros((m, reach + 1), bool)
    right_class, back_class = np.empty(m, np.int64), np.empty(m, np.int64)
    twice = fragments["twice"].astype(bool)
    for o in range(reach + 1):
        own = np.flatnonzero((o <= left) & (o >= left - more))
        if not len(own):
            continue
        right_class[right] = np.cumsum(right_common < length - o)
        back_class[back] = np.cumsum(back_common < o) if o else 0
        _, at, times = np.unique(right_class[own] * (m + 1) + back_class[own], return_inverse=True, return_counts=True)
        out[own, o] = (times[at] > 1) | twice[own]
    return out


_STRINGS = b"\xff\xff\xff\xff"  # the first bytes of a message of strings; others begin with the number of their fragments


def _meet_fragments(asked: list[bytes], length: int, gram: int) -> list[bytes]:
    if asked[0][:4] == _STRINGS:  # these have buckets of their own
        return _meet_strings(asked)
    heads, texts = [], []
    for m in asked:
        k = int(np.frombuffer(m, np.uint32, 1)[0])
        heads.append(np.frombuffer(m, FRAGMENT, k, 4))
        texts.append(np.frombuffer(m, np.uint8, offset=4 + k * FRAGMENT.itemsize))
    fragments, text = np.concatenate(heads), np.concatenate(texts)
    text[text == 0] = 0xFF  # UTF-8 has no 0xFF; 0 pads
    size = fragments["more"].astype(np.int64) + length
    start = np.cumsum(size) - size
    # equal strings have the same gram: some grams at a time
    order = np.argsort(fragments["gram"], kind="stable")
    grams = fragments["gram"][order]
    heads_at = np.concatenate([[0], np.flatnonzero(grams[1:] != grams[:-1]) + 1, [len(grams)]])
    bits = np.zeros((len(fragments), (length - gram + 8) // 8), np.uint8)
    lo = 0
    while lo < len(grams):
        hi = int(heads_at[max(np.searchsorted(heads_at, lo + AT_ONCE, "right") - 1, np.searchsorted(heads_at, lo, "right"))])
        some = order[lo:hi]
        bits[some] = np.packbits(repeated_strings(fragments[some], start[some], text, length, gram), axis=1)
        lo = hi
    ends = np.cumsum([len(h) for h in heads])
    return [bits[e - len(h) : e].tobytes() for h, e in zip(heads, ends, strict=True)]


def _own_note(told: dict[int, bytes]) -> bytes:
    return next(v for b, v in told.items() if b < 0)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, removed, kept): ``removed`` are the maximal runs of removed bytes, ``kept`` the other
    bytes of the text. A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too."""
    if not 1 <= gram <= length or length > 60_000:
        raise ValueError("gram must be from 1 to length, length at most 60,000")
    n = pieces(docs)
    chunks = chunked(docs, id_col, text_col, n)

    def grams(rows: pa.Table) -> list[tuple[int, bytes]]:
        parts, texts = [], []
        for lo, _, buf, offsets in slices(_in_order(rows).column("text")):
            parts.append(own := find_anchors(buf, offsets, lo, length, gram))
            start = offsets[own["doc"] - lo] + own["first"]
            texts.append(byte_ranges(buf)(start, start + (own["last"] - own["first"]) + length))
        found, texts = np.concatenate(parts), np.concatenate(texts)
        values, at, times = np.unique(found["gram"], return_inverse=True, return_counts=True)
        entries = np.zeros(len(values), GRAM_ENTRY)
        entries["gram"], entries["twice"] = values, times > 1
        _, distinct = np.unique(mix(texts ^ found["gram"]), return_index=True)
        entries["fragments"] = np.minimum(np.bincount(at[distinct], minlength=len(values)), _MOST)
        return [
            *((b, entries[s:e].tobytes()) for b, s, e in bucket_runs(values, n)),
            (note(rows.column("chunk")[0].as_py()), found.tobytes()),
        ]

    def hot_strings(rows: pa.Table, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, start) of all strings of some anchors, and their hashes."""
        docs, places, hashes = [], [], []
        for lo, hi, buf, offsets in slices(rows.column("text")):
            a, b = np.searchsorted(anchors["doc"], [lo, hi])
            own = anchors[a:b]
            if len(own):
                many = (own["last"] - own["first"] + 1).astype(np.int64)
                place = np.repeat(own["first"] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                doc = np.repeat(own["doc"], many)
                docs.append(doc)
                places.append(place)
                hashes.append(_string_hashes(buf, length)[offsets[doc - lo] + place])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *docs]), np.concatenate([none, *places]), np.concatenate([np.zeros((0, 2), U), *hashes])

    def fragments(rows: pa.Table, told: dict[int, bytes]) -> list[tuple[int, bytes]]:
        found = np.frombuffer(_own_note(told), ANCHOR)
        values = np.unique(found["gram"])
        none = (np.zeros(0, bool), np.zeros(0, bool))
        shared, many = (np.concatenate(x) for x in zip(none, *(_flags(told[b], e - s) for b, s, e in bucket_runs(values, n)), strict=True))
        at = np.searchsorted(values, found["gram"])
        hot_ones, found = found[shared[at] & many[at]], found[shared[at] & ~many[at]]
        _, _, strings = hot_strings(_in_order(rows), hot_ones)
        strings, times = np.unique(strings, axis=0, return_counts=True)
        strings[:, 1] |= (times > 1).astype(U)
        hot_rows = [(n + b, _STRINGS + strings[s:e].tobytes()) for b, s, e in bucket_runs(strings[:, 0], n)]
        names = np.zeros((len(found), 2), U)
        names[:, 0] = found["gram"]
        parts = []
        for lo, hi, buf, offsets in slices(_in_order(rows).column("text")):
            a, b = np.searchsorted(found["doc"], [lo, hi])
            own = found[a:b]
            start = offsets[own["doc"] - lo] + own["first"]
            stop = start + (own["last"] - own["first"]) + length
            names[a:b, 1] = byte_ranges(buf)(start, stop) ^ (own["at"] - own["first"]).astype(U)
            data = buf.tobytes()
            parts += [data[s:e] for s, e in zip(start.tolist(), stop.tolist(), strict=True)]
        distinct, first, at, times = np.unique(names, axis=0, return_index=True, return_inverse=True, return_counts=True) if len(found) else (names, *[np.zeros(0, int)] * 3)
        heads = np.zeros(len(distinct), FRAGMENT)
        heads["gram"], heads["twice"] = distinct[:, 0], times > 1
        heads["left"] = (found["at"] - found["first"])[first]
        heads["more"] = (found["last"] - found["first"])[first]
        pick = first.tolist()
        out = [
            (b, np.uint32(e - s).tobytes() + heads[s:e].tobytes() + b"".join(parts[i] for i in pick[s:e]))
            for b, s, e in bucket_runs(distinct[:, 0], n)
        ]
        kept = np.concatenate([found["doc"], found["at"], at.reshape(-1).astype(np.int32)]).astype(np.int32)
        own = np.int64(len(found)).tobytes() + kept.tobytes() + hot_ones.tobytes()
        return [*out, *hot_rows, (note(rows.column("chunk")[0].as_py()), own)]

    def result(rows: pa.Table, told: dict[int, bytes]) -> pa.Table:
        rows = _in_order(rows)
        own = _own_note(told)
        m = int(np.frombuffer(own, np.int64, 1)[0])
        doc, place, entry = np.frombuffer(own, np.int32, 3 * m, 8).reshape(3, -1)
        width = (length - gram + 8) // 8
        hot_doc, hot_place, strings = hot_strings(rows, np.frombuffer(own, ANCHOR, offset=8 + 12 * m))
        if len(strings):
            distinct, at = np.unique(strings, axis=0, return_inverse=True)
            twice = np.concatenate([np.unpackbits(np.frombuffer(told[n + b], np.uint8), count=e - s) for b, s, e in bucket_runs(distinct[:, 0], n)])
            again = twice[at.reshape(-1)].astype(bool)
            hot_doc, hot_place = hot_doc[again], hot_place[again]
        replies = [np.frombuffer(told[b], np.uint8) for b in sorted(told) if 0 <= b < n]
        bits = np.concatenate(replies or [np.zeros(0, np.uint8)]).reshape(-1, width)
        ids = rows.column("doc_id").to_numpy()
        columns: dict[str, list] = {f.name: [] for f in _SCHEMA}
        for lo, hi, buf, offsets in slices(rows.column("text")):
            a, b = np.searchsorted(doc, [lo, hi])
            steps = np.zeros(len(buf) + 1, np.int32)
            which, back = np.nonzero(np.unpackbits(bits[entry[a:b]], axis=1, count=length - gram + 1))
            start = offsets[doc[a:b][which] - lo] + place[a:b][which] - back
            c, d = np.searchsorted(hot_doc, [lo, hi])
            start = np.concatenate([start, offsets[hot_doc[c:d] - lo] + hot_place[c:d]])
            np.add.at(steps, start, 1)
            np.add.at(steps, start + length, -1)
            gone = np.cumsum(steps[:-1]) > 0
            data = buf.tobytes()
            touched = np.zeros(hi - lo, bool)
            touched[doc[a:b][which] - lo] = True
            touched[hot_doc[c:d] - lo] = True
            for k in range(hi - lo):
                s, e = int(offsets[k]), int(offsets[k + 1])
                columns["doc_id"].append(int(ids[lo + k]))
                columns["n_bytes"].append(e - s)
                spans: list[dict[str, int]] = []
                if touched[k]:
                    from_, to = runs(gone[s:e])
                    spans = [{"start": x, "end": y} for x, y in zip(from_.tolist(), to.tolist(), strict=True)]
                columns["n_removed"].append(sum(x["end"] - x["start"] for x in spans))
                columns["n_spans"].append(len(spans))
                columns["removed"].append(spans)
                columns["kept"].append(buf[s:e][~gone[s:e]].tobytes() if spans else data[s:e])
        return pa.table([pa.array(columns[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)

    shared = answer(ask(chunks, grams), lambda asked: _meet_grams(asked, hot))
    repeated = answer(ask(chunks, fragments, shared), lambda asked: _meet_fragments(asked, length, gram))
    return conclude(chunks, repeated, result, SCHEMA)
