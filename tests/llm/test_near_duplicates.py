"""MinHash near-duplicates and components against brute force."""

import random

import brute
import numpy as np
import pytest
from tallyflow.llm.components import connected_components
from tallyflow.llm.minhash_dedup import band_keys, densified, near_duplicates


def result(table, rows, **options):
    out = near_duplicates(table(rows), **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return {r.doc_id: r.component_id for r in out}, sorted((r.doc_id, r.n_shingles) for r in out)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(table, texts, percent):
    assert result(table, texts, percent=percent) == brute.near_duplicates(texts, percent)


def test_a_star_whose_centre_holds_nothing_together(table):
    """Copies of a hidden text whose smallest member is unlike the others, which are alike in pairs."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(200)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rnd.randrange(len(words))] = f"e{rnd.random()}"
        return words

    rows = [(0, " ".join(edited(base, 9)))]
    for i in range(1, 40):
        part = edited(base, 6)
        rows += [(2 * i, " ".join(part)), (2 * i + 1, " ".join(edited(part, 1)))]
    assert result(table, rows) == brute.near_duplicates(rows)


def test_a_star_of_a_thousand_unlinked_members(table):
    """A template that a thousand documents share and fill in differently: alike enough to meet, too unlike to be linked, but for pairs."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1000):
        words = list(base)
        for place in range(3, 60, 15):
            words[place] = f"own{i}-{place}"
        rows.append((i + 5, " ".join(words)))
        if i % 50 == 0:
            rows.append((5000 + i, " ".join([*words, f"tail{i}"])))
    rnd.shuffle(rows)
    got, sizes = result(table, rows)
    assert len(sizes) == 1020
    assert got == {d: d - 4995 if d >= 5000 else d for d, _ in rows}


def test_components_of_paths_stars_and_loops(spark):
    rnd = random.Random(2)
    nodes = list(range(100))
    rnd.shuffle(nodes)
    edges = list(zip(nodes[:60], nodes[1:60])) + [(nodes[60], n) for n in nodes[61:90]] + [(nodes[95], nodes[95]), (5, None)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    path, star = nodes[:60], nodes[60:90]
    assert got == {n: min(path) for n in path} | {n: min(star) for n in star}


def test_densified_bins_agree_as_often_as_sets_are_alike():
    rnd = np.random.default_rng(4)
    pool = rnd.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)
    agree = []
    for _ in range(150):
        both, a, b = np.split(rnd.permutation(pool)[:40], [28, 34])
        sets = [np.unique(np.concatenate([both, x])) for x in (a, b)]
        keys = band_keys(sets, bands=128, rows=1)
        agree.append((keys[0] == keys[1]).mean())
    assert abs(np.mean(agree) - 28 / 40) < 0.03


def test_densified_copies_only_filled_bins():
    bins, filled = np.zeros((2, 128), np.uint64), np.zeros((2, 128), bool)
    bins[0, 3], filled[0, 3] = 7, True
    bins[1, [1, 100]], filled[1, [1, 100]] = [5, 6], True
    out = densified(bins, filled)
    assert set(out[0]) == {7} and set(out[1]) == {5, 6}


def test_empty_table(table):
    assert near_duplicates(table([]).limit(0)).count() == 0
    assert [tuple(r) for r in near_duplicates(table([(4, None)])).collect()] == [(4, 0, 4, True)]
