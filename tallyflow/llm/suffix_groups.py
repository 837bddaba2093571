"""Suffix sorting by linear grouping, after U. Baier, "Linear-time suffix sorting" (CPM 2016).

First phase: suffixes are grouped by their Lyndon prefix. Groups are taken in descending order; a member's pointer leads to the
nearest earlier suffix of a smaller group, whose prefix the member's prefix prolongs. Suffixes pointed at leave their group for a
new one directly behind it, those with more pointers further behind. Second phase: groups are filled in ascending order, each
suffix placed handing its place on along the pointers. There is no recursion and no renaming of symbols between rounds.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Starts of all suffixes in their order; a suffix that is a prefix of another comes first."""
    n = len(symbols) + 1
    text = np.empty(n, np.int64)
    text[:-1] = symbols
    text[-1] = text[:-1].min() - 1 if n > 1 else 0
    order = np.argsort(text, kind="stable")
    head = np.concatenate([[True], np.diff(text[order]) != 0])
    start_of = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = start_of[place].tolist()  # of a suffix: where its group starts
    size = np.bincount(start_of, minlength=n).tolist()
    ranked, place = order.tolist(), place.tolist()
    smaller = [-1] * n
    end = n
    while end:
        start = group[ranked[end - 1]]
        members = ranked[start:end]
        members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0:
                g = group[p]
                if g < start:
                    break
                p = smaller[p]
                if g == start:
                    break
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = start
        times = set(pointed.values())
        for k in sorted(times, reverse=True):
            heads: dict[int, list[int]] = {}
            for p, m in pointed.items():
                if m == k:
                    heads.setdefault(group[p], []).append(p)
            for g, moved in heads.items():
                if len(moved) == size[g]:
                    continue
                tail = g + size[g]
                size[g] -= len(moved)
                new = g + size[g]
                size[new] = len(moved)
                for p in moved:
                    tail -= 1
                    a, q = place[p], ranked[tail]
                    ranked[a], place[q] = q, a
                    ranked[tail], place[p] = p, tail
                    group[p] = new
    out, free, placed = [-1] * n, list(range(n)), bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out[1:]


def row_order(rows: np.ndarray, block: int) -> np.ndarray:
    """Order of the rows of a byte matrix, from the suffix array of all rows in a line.

    ``block`` bytes make one symbol, numbered in byte order, and 0 ends a row; the suffixes that start with a row give the order.
    Bytes of 0 pad short rows.
    """
    m, width = rows.shape
    if not width:
        return np.arange(m)
    per_row = -(-width // block)
    padded = np.zeros((m, per_row * block), np.uint8)
    padded[:, :width] = rows
    _, names = np.unique(padded.reshape(-1).view(f"S{block}"), return_inverse=True)
    line = np.zeros((m, per_row + 1), np.int64)
    line[:, :-1] = names.reshape(m, per_row) + 1
    ranked = np.array(suffix_array(line.reshape(-1)), np.int64)
    return ranked[ranked % (per_row + 1) == 0] // (per_row + 1)


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it; 0 for the first row."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1 and rows.shape[1]:
        differ = rows[1:] != rows[:-1]
        at = differ.argmax(axis=1)
        out[1:] = np.where(differ[np.arange(len(at)), at], at, rows.shape[1])
    return out
