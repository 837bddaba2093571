"""Re-Pair grammars of integer sequences: frequent pairs become new symbols, again and again.

Every round counts the pairs of the sequence as it stands, makes the frequent ones rules, and replaces their occurrences from the
more frequent pair to the less where they overlap. Rules of a round consist of symbols of earlier rounds, so a rule's expansion
is made from those before it. Expansion lengths are kept: from their sums a reader finds the symbols that hold any range of ids.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MIN_USES = 4  # a rule costs two symbols
ROUNDS = 24
LEAST_GAIN = 0.04  # share of symbols that a round must save to be followed by another
_TABLE_BITS = 18
_MAGIC = b"RPG1"


def _spread(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    """Places of pairs in a table of 2**_TABLE_BITS, others with every salt."""
    x = left.view(np.uint32) * np.uint32(0x9E3779B1)
    x ^= (right.view(np.uint32) + np.uint32(salt)) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x >>= np.uint32(32 - _TABLE_BITS)
    return x.astype(np.int64)


def _chosen(rank: np.ndarray) -> np.ndarray:
    """Places of the pairs to replace: those of higher rank than both neighbours, and every other one of a run of one pair (x x x x)."""
    padded = np.zeros(len(rank) + 2, rank.dtype)
    padded[1:-1] = rank
    rises, falls = padded[1:-1] > padded[:-2], padded[1:-1] > padded[2:]
    top = np.flatnonzero(rises & falls)
    starts = np.flatnonzero(rises & (padded[1:-1] == padded[2:]))
    if not len(starts):
        return top
    ends = np.flatnonzero((padded[1:-1] == padded[:-2]) & (padded[1:-1] != padded[2:]) & (rank > 0))
    ends = ends[np.searchsorted(ends, starts)]  # the end of the run that starts there
    right = padded[2:]
    whole = rank[ends] > right[ends]
    starts, sizes = starts[whole], ((ends - starts)[whole] >> 1) + 1
    before = np.cumsum(sizes) - sizes
    alternate = np.repeat(starts - 2 * before, sizes) + 2 * np.arange(sizes.sum())
    return np.sort(np.concatenate([top, alternate]))


@dataclass
class Grammar:
    """Rules (pairs of symbols, the first rule being symbol ``alphabet``), the length of each rule's expansion, and the sequence."""

    alphabet: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, last: np.ndarray, alphabet: int) -> Grammar:
        """The grammar of a sequence. No symbol goes on behind an id that is ``last`` (of its document)."""
        seq, last = ids.astype(np.int32), np.flatnonzero(last)
        lefts, rights, lengths = [], [], [np.ones(alphabet, np.int64)]
        size = alphabet
        for salt in range(ROUNDS):
            if len(seq) < 2:
                break
            place = _spread(seq[:-1], seq[1:], salt)
            place[last[last < len(place)]] = 1 << _TABLE_BITS  # no pair
            counts = np.bincount(place, minlength=(1 << _TABLE_BITS) + 1)
            counts[-1] = 0
            # places that many pairs meet in are looked at again: one pair is the place's, and counted exactly
            at = np.flatnonzero((counts >= MIN_USES)[place])
            if not len(at):
                break
            place = place[at]
            pair = seq[at].astype(np.int64) << 32 | seq[at + 1]
            holder = np.zeros(1 << _TABLE_BITS, np.int64)
            holder[place] = pair
            own = holder[place] == pair
            uses = np.bincount(place[own], minlength=1 << _TABLE_BITS)
            frequent = np.flatnonzero(uses >= MIN_USES)
            order = frequent[np.argsort(uses[frequent], kind="stable")]  # by uses, then by place
            ranks = np.zeros(1 << _TABLE_BITS, np.int32)
            ranks[order] = np.arange(1, len(order) + 1)
            rank = np.zeros(len(seq), np.int32)
            rank[at] = ranks[place] * own
            where = _chosen(rank)
            place = order[rank[where] - 1]
            uses = np.bincount(place, minlength=1 << _TABLE_BITS)
            kept = uses[place] >= MIN_USES
            where, place = where[kept], place[kept]
            if len(where) < max(MIN_USES, LEAST_GAIN * len(seq)):
                break
            made = np.flatnonzero(uses >= MIN_USES)
            number = np.zeros(1 << _TABLE_BITS, np.int32)
            number[made] = size + np.arange(len(made))
            l, r = (holder[made] >> 32).astype(np.int32), (holder[made] & 0xFFFFFFFF).astype(np.int32)
            known = np.concatenate(lengths) if len(lengths) > 1 else lengths[0]
            lengths = [known, known[l] + known[r]]
            lefts.append(l)
            rights.append(r)
            size += len(made)
            seq[where] = number[place]
            keep = np.ones(len(seq), bool)
            keep[where + 1] = False
            seq, last = seq[keep], last - np.searchsorted(where, last)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return Grammar(alphabet, join(lefts), join(rights), np.concatenate(lengths)[alphabet:], seq)

    def _expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all symbols one after another, and where each symbol's start and how many they are."""
        sizes = np.concatenate([np.ones(self.alphabet, np.int64), self.lengths])
        starts = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.int32)
        ids[: self.alphabet] = np.arange(self.alphabet)
        done = self.alphabet
        while done < len(sizes):  # the rules whose symbols are all made
            left, right = self.left[done - self.alphabet :], self.right[done - self.alphabet :]
            late = np.flatnonzero(np.maximum(left, right) >= done)
            n = int(late[0]) if len(late) else len(left)
            parts = np.column_stack([left[:n], right[:n]]).ravel()
            made = ids[spans(starts[parts], sizes[parts])]
            ids[starts[done] : starts[done] + len(made)] = made
            done += n
        return ids, starts, sizes

    def n_ids(self) -> int:
        return int(np.concatenate([np.ones(self.alphabet, np.int64), self.lengths])[self.symbols].sum())

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from ``first`` to ``end``; only symbols that hold some of them are expanded."""
        content, starts, sizes = self._expansions()
        ends = np.cumsum(sizes[self.symbols])
        total = int(ends[-1]) if len(ends) else 0
        end = total if end is None else min(end, total)
        if first >= end:
            return np.zeros(0, np.int32)
        lo, hi = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, end, "left")) + 1
        part = self.symbols[lo:hi]
        out = content[spans(starts[part], sizes[part])]
        skip = first - (int(ends[lo - 1]) if lo else 0)
        return out[skip : skip + end - first]

    def pack(self) -> bytes:
        """Magic, alphabet, numbers of rules and symbols; then 16 low and 8 high bits of left, right and symbols, and 32-bit lengths."""
        head = _MAGIC + struct.pack("<III", self.alphabet, len(self.left), len(self.symbols))
        planes = [p for x in (self.left, self.right, self.symbols) for p in ((x & 0xFFFF).astype("<u2").tobytes(), (x >> 16).astype(np.uint8).tobytes())]
        return b"".join([head, *planes, self.lengths.astype("<u4").tobytes()])

    @staticmethod
    def unpack(data: bytes) -> Grammar:
        if data[:4] != _MAGIC:
            raise ValueError("not a grammar")
        alphabet, n_rules, n_symbols = struct.unpack_from("<III", data, 4)
        at, out = 16, []
        for n in (n_rules, n_rules, n_symbols):
            low = np.frombuffer(data, "<u2", n, at).astype(np.int32)
            high = np.frombuffer(data, np.uint8, n, at + 2 * n).astype(np.int32)
            out.append(low | high << 16)
            at += 3 * n
        lengths = np.frombuffer(data, "<u4", n_rules, at).astype(np.int64)
        return Grammar(alphabet, out[0], out[1], lengths, out[2])


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges [start, start + size), range after range."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
