"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(256)).lower()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def substring_dedup(rows, window=13):
    """{id: [(n_words, n_removed, kept words)] sorted}"""
    words = [(d, WORD.findall((t or "").encode())) for d, t in rows if d is not None]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = defaultdict(list)
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d].append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return {d: sorted(v) for d, v in out.items()}


def suffix_dedup(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows if d is not None]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = defaultdict(list)
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d].append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return {d: sorted(v) for d, v in out.items()}


def line_dedup(rows, min_chars=40, min_docs=5):
    strip = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(strip(line)) >= min_chars:
                holders[strip(line)].add(d)
    out = defaultdict(list)
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(strip(x)) < min_chars or len(holders[strip(x)]) < min_docs or max(holders[strip(x)]) == d]
        out[d].append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return {d: sorted(v) for d, v in out.items()}


def shingles(text, size=5):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_duplicates(rows, percent=85, size=5):
    """({id: component}, [(id, n_shingles)] sorted)"""
    sets = [(d, shingles(t, size)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}, sorted((d, len(s)) for d, s in sets)


def fold(text):
    return "".join(" " if c in " \t\n\x0b\x0c\r" else c.lower() if "A" <= c <= "Z" else c for c in text)


def edits_within(pattern, text):
    """Least edits between a pattern and any part of a text."""
    points = np.array([ord(c) for c in text], np.int64)
    steps = np.arange(len(points) + 1)
    before = np.zeros(len(points) + 1, np.int64)
    for i, c in enumerate(pattern, 1):
        row = before + 1
        row[0] = i
        row[1:] = np.minimum(row[1:], before[:-1] + (points != ord(c)))
        before = np.minimum.accumulate(row - steps) + steps  # from the left, one edit a step
    return int(before.min())


def held_items(text, items, q=12, probe=96, min_chars=24, rate=0.05, passage=50, step=7):
    """{item: edits} of the items a text holds: by probes of 96 characters, and by those that every passage of 50 holds one of."""
    out = {}
    for item, pattern in items:
        if pattern is None or len(pattern) < max(min_chars, q):
            continue
        pattern = fold(pattern)
        cuts = [(probe, probe // 2)]
        if passage and len(pattern) >= passage:
            cuts.append((passage - step + 1, step))
        for size, every in cuts:
            last = max(len(pattern) - size, 0)
            for at in sorted({*range(0, last, every), last}):
                part = pattern[at : at + size]
                e = edits_within(part, fold(text or ""))
                if e <= min(int(len(part) * rate), (len(part) - q) // q):
                    out[item] = min(out.get(item, e), e)
    return out


def best_path(word, scores, unknown, byte_ids, texts):
    """Ids and score of the best path of pieces through a word given as bytes."""
    best = {0: (0.0, [])}
    for s in range(len(word)):
        if s not in best or word[s] & 0xC0 == 0x80:
            continue
        size = 1 + (word[s] >= 0xC0) + (word[s] >= 0xE0) + (word[s] >= 0xF0)
        ends = {e: texts[word[s:e]] for e in range(s + 1, len(word) + 1) if word[s:e] in texts}
        options = [(e, best[s][0] + scores[i], [i]) for e, i in ends.items()]
        if s + size not in ends:
            options.append((s + size, best[s][0] + unknown, [byte_ids[b] for b in word[s : s + size]]))
        for e, total, ids in options:
            if e not in best or total > best[e][0]:
                best[e] = total, best[s][1] + ids
    return best[len(word)]


def sha_hex(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle(rows, tampered, fanout=8):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root)] sorted, of (doc_id, text, lang, source, n_chars) rows; ``tampered`` maps
    (doc_id, text) to the text that takes its place."""

    def leaf(doc_id, text, lang, source, n_chars):
        framed = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
        return sha_hex("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in framed))

    def climb(level):
        """Digests of the levels from the leaves to the root."""
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha_hex("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def steps(levels, place):
        for level in levels[:-1]:
            lo = place // fanout * fanout
            yield "".join(level[lo:place]), "".join(level[place + 1 : lo + fanout])
            place //= fanout

    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(*row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for place, (_, _, own, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            trail = [*steps(trees[g], place), *steps(top, k)]
            node = leaf(row[0], tampered(row[0], row[1]), *row[2:])
            for left, right in trail:
                node = sha_hex(left + node + right)
            out.append((row[0], own, trees[g][-1][0], top[-1][0], sha_hex("".join(a + b for a, b in trail)), node))
    return sorted(out, key=repr)


def word_runs(text):
    """Words between ASCII bytes other than letters and digits, and all runs of one to three of them."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))
    return words, [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(rows, target, buckets=10_000, percent=5, min_words=20, seed="42"):
    """[(doc_id, n_features, weight, score, rank)] sorted."""
    bucket = lambda f: zlib.crc32(f) % buckets
    held = [(d, *word_runs(t)) for d, t in rows]
    source, goal = Counter(bucket(f) for _, _, runs in held for f in runs), Counter(bucket(f) for t in target for f in word_runs(t)[1])
    s_all, t_all = source.total(), goal.total()
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets))))
    out, may = [], []
    for d, words, runs in held:
        weight, score = sum(gain(bucket(f)) for f in runs), None
        if d is not None:
            h = int(sha_hex(f"{seed}:{d}")[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words) >= min_words:
                may.append((-score, d, len(out)))
        out.append([d, len(runs), weight, score, None])
    for rank, (_, _, k) in enumerate(sorted(may)[: percent * len(may) // 100], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=repr)


def levenshtein(a, b):
    before = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            row.append(min(before[j - 1] + (c != d), before[j] + 1, row[j - 1] + 1))
        before = row
    return before[-1]


def lexicon_hit(word, terms, stems, innocent, fuzzy_from=5, two_from=10):
    """The term a word stands for: as it is, by its beginning, or with edits."""
    found = [(terms[word], word, 0)] if word in terms else []
    found += [(weight, stem + "*", 0) for stem, weight in stems.items() if word.startswith(stem)]
    if not found and word not in innocent and len(word) >= fuzzy_from - 1:
        for term, weight in terms.items():
            edits = levenshtein(word, term)
            if len(term) >= fuzzy_from and 0 < edits <= (2 if len(term) >= two_from else 1):
                found.append((weight * 0.5**edits, term, edits))
    return max(found, key=lambda x: x[0], default=None)
