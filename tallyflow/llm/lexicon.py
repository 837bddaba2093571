"""A weighted lexicon in a trie, and Levenshtein automata to look words up in it with misspellings.

The automaton of a word reads a term letter by letter. Its state is the set of (letters of the word consumed, edits so far) that can
still succeed, without those that another one makes needless. Walking the trie with it visits just the branches that the automaton
still accepts, so shared beginnings of terms are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tallyflow.llm.kernels import U, mix

State = tuple[tuple[int, int], ...]


class LevenshteinAutomaton:
    """Accepts all strings within ``edits`` insertions, deletions and substitutions of ``word``."""

    def __init__(self, word: str, edits: int) -> None:
        self.word, self.edits = word, edits
        self._steps: dict[tuple[State, str], State] = {}

    def start(self) -> State:
        return self._closed({(0, 0)})

    def _closed(self, places: set[tuple[int, int]]) -> State:
        for i, e in sorted(places):  # letters of the word that are left out
            for k in range(1, min(self.edits - e, len(self.word) - i) + 1):
                places.add((i + k, e + k))
        return tuple(sorted((i, e) for i, e in places if not any((j, f) != (i, e) and f < e and abs(i - j) <= e - f and e - f > 0 and j == i for j, f in places)))

    def step(self, state: State, letter: str) -> State:
        key = (state, letter)
        if key not in self._steps:
            after: set[tuple[int, int]] = set()
            for i, e in state:
                if i < len(self.word) and self.word[i] == letter:
                    after.add((i + 1, e))
                elif e < self.edits and i < len(self.word):
                    after.add((i + 1, e + 1))
                if e < self.edits:
                    after.add((i, e + 1))
            self._steps[key] = self._closed(after)
        return self._steps[key]

    def distance(self, state: State) -> int | None:
        """Edits with which the whole word is consumed, if it can be."""
        return min((e for i, e in state if i == len(self.word)), default=None)


_BASE = 0x2545F4914F6CDD1D
_INVERSE, _INVERSE_2 = (U(pow(_BASE, -n, 1 << 64)) for n in (1, 2))


#: Hashes tested at a time.
AT_ONCE = 1 << 20


class _Prefixes:
    """Hashes of the beginnings of many words, whole and without any one letter."""

    def __init__(self, words: list[str], width: int) -> None:
        width = max(width, 1)
        letters = np.zeros((len(words), width), np.uint32)
        self.sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer("".join(w[:width] for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.arange(width) < self.sizes[:, None]
        letters[inside] = data
        powers = np.full(width, _BASE, U)
        powers[0] = 1
        powers = np.cumprod(powers)
        self.sums = np.zeros((len(words), width + 1), U)
        np.cumsum(np.where(inside, mix(letters.astype(U) + U(1)) * powers, U(0)), axis=1, out=self.sums[:, 1:])

    def whole(self, rows: np.ndarray, k: int) -> np.ndarray:
        return mix(self.sums[rows, k] ^ U(k))

    def variants(self, rows: np.ndarray, k: int, deletions: int) -> np.ndarray:
        """Hashes of some words of k letters, whole and without any one or two of their letters."""
        sums = self.sums[rows]
        end = sums[:, k, None]
        parts = [end ^ U(k)]
        if deletions and k:
            i = np.arange(k)
            parts.append((sums[:, i] + (end - sums[:, i + 1]) * _INVERSE) ^ U(k - 1))
        if deletions > 1 and k > 1:
            i, j = np.triu_indices(k, 1)
            parts.append((sums[:, i] + (sums[:, j] - sums[:, i + 1]) * _INVERSE + (end - sums[:, j + 1]) * _INVERSE_2) ^ U(k - 2))
        return mix(np.concatenate(parts, axis=1))


def _neighbourhood(words: list[str], deletions: int) -> np.ndarray:
    """Hashes of words and of what they are without some letters."""
    by_size: dict[int, list[str]] = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    parts = [_Prefixes(some, size).variants(np.arange(len(some)), size, deletions).ravel() for size, some in by_size.items()]
    return np.concatenate([np.zeros(0, U), *parts])


class _Hashes:
    """A set of hashes that says fast of most others that they are not in it."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.values = np.unique(hashes)
        self.shift = U(64 - max(10, (16 * len(self.values)).bit_length()))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.values >> self.shift] = True

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes are in the set."""
        out = self.bits[hashes >> self.shift]
        some = np.nonzero(out)
        if len(some[0]):
            found = hashes[some]
            at = np.minimum(np.searchsorted(self.values, found), len(self.values) - 1)
            out[some] = self.values[at] == found
        return out


class Lexicon:
    """Terms and stems with weights. A stem stands for all words that begin with it. All terms that have enough letters are also found
    misspelled, except as words known to be innocent."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], innocent: frozenset[str] = frozenset(), fuzzy_from: int = 5, two_from: int = 10) -> None:
        self.terms, self.stems, self.innocent = terms, stems, innocent
        self.lengths = sorted({len(s) for s in stems})
        self.fuzzy_from, self.two_from = fuzzy_from, two_from
        self.tries: dict[int, dict] = {1: {}, 2: {}}  # of the terms that may have so many edits
        for term in terms:
            if len(term) >= fuzzy_from:
                node = self.tries[self.budget(term)]
                for letter in term:
                    node = node.setdefault(letter, {})
                node[""] = term
        self._sets: tuple[_Hashes, ...] | None = None

    def __reduce__(self):
        """Sent as its terms; the tries are as deep as these are long."""
        return Lexicon, (self.terms, self.stems, self.innocent, self.fuzzy_from, self.two_from)

    def budget(self, term: str) -> int:
        return 2 if len(term) >= self.two_from else 1

    def look_up(self, word: str, edits: tuple[int, ...] = (1, 2)) -> tuple[str, float, int] | None:
        """The best (term, weight, edits) for a word. Misspelled terms weigh half for each edit. ``edits`` says for which budgets
        misspelled terms may be found."""
        found = (word, self.terms[word], 0) if word in self.terms else None
        for n in self.lengths:
            weight = self.stems.get(word[:n])
            if weight is not None and len(word) >= n and (found is None or weight > found[1]):
                found = (word[:n] + "*", weight, 0)
        if found or word in self.innocent or len(word) < self.fuzzy_from - 1:
            return found
        return max((hit for most in edits for hit in self._misspelled(word, most)), key=lambda x: (x[1], x[0]), default=None)

    def may_hit(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the words ``look_up`` may find something for: as they are or by a stem, and with one or up to two edits.

        Two strings are n edits apart at most only if they are equal once each has lost n letters at most, so words whose deletion
        neighbourhood meets that of no term are told by their hashes. Of the others nearly all are found.
        """
        if self._sets is None:
            near = [[t for t in self.terms if len(t) >= self.fuzzy_from and self.budget(t) == n] for n in (1, 2)]
            self._longest = max((len(t) for t in near[1]), default=0)
            self._sets = (_Hashes(_neighbourhood(list(self.stems), 0)), *(_Hashes(_neighbourhood(some, n)) for n, some in enumerate(near, 1)))
        stems, one, two = self._sets
        known = np.array([w in self.terms for w in words], bool)
        near = {1: np.zeros(len(words), bool), 2: np.zeros(len(words), bool)}
        if len(words):
            p = _Prefixes(words, max([*self.lengths, self._longest + 2, self.two_from]))
            for n in self.lengths:
                rows = np.flatnonzero(p.sizes >= n)
                known[rows] |= stems.hold(p.whole(rows, n))
            for n, held, sizes in ((1, one, range(self.fuzzy_from - 1, self.two_from + 1)), (2, two, range(self.two_from - 2, self._longest + 3))):
                for size in sizes if len(held.values) else ():
                    rows = np.flatnonzero((p.sizes == size) & ~known)
                    at_once = max(1, AT_ONCE // (1 + size + size * size // 2))
                    for lo in range(0, len(rows), at_once):
                        some = rows[lo : lo + at_once]
                        near[n][some] = held.hold(p.variants(some, size, n)).any(axis=1)
        return known, near[1], near[2]

    def look_up_all(self, words: list[str]) -> dict[str, tuple[str, float, int]]:
        """``look_up`` of many words: those that are found."""
        known, one, two = self.may_hit(words)
        out = {}
        for i in np.flatnonzero(known | one | two).tolist():
            if found := self.look_up(words[i], tuple(n for n, near in ((1, one), (2, two)) if near[i])):
                out[words[i]] = found
        return out

    def _misspelled(self, word: str, most: int) -> Iterator[tuple[str, float, int]]:
        trie = self.tries[most]
        automaton = LevenshteinAutomaton(word, most)
        walk = [(trie, automaton.start())]
        while walk:
            node, state = walk.pop()
            for letter, child in node.items():
                if letter == "":
                    if edits := automaton.distance(state):
                        yield child, self.terms[child] * 0.5**edits, edits
                elif after := automaton.step(state, letter):
                    walk.append((child, after))
