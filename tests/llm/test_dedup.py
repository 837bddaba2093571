"""Substring, suffix-array and line dedup against brute force."""

import random
from collections import defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyflow.llm.kernels import Words, slices
from tallyflow.llm.line_dedup import line_bitmaps, line_dedup
from tallyflow.llm.rendezvous import chunked, stored_bytes
from tallyflow.llm.substring_dedup import difference_cover, substring_dedup
from tallyflow.llm.suffix_dedup import HOT, sliding_least, suffix_dedup
from tallyflow.llm.suffix_groups import common_prefixes, row_order, suffix_array


def grouped(rows):
    out = defaultdict(list)
    for key, *rest in rows:
        out[key].append(tuple(rest))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("period", [1, 2, 3, 7, 10, 13])
def test_difference_cover_has_every_difference(period):
    cover = difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize(("window", "period"), [(13, 7), (13, 13), (5, 3), (2, 1)])
def test_substring_dedup(table, texts, window, period):
    out = substring_dedup(table(texts), window=window, period=period).collect()
    got = grouped((r.doc_id, r.n_words, r.n_removed, r.kept_text.encode()) for r in out)
    assert got == brute.substring_dedup(texts, window)
    by_id = {r.doc_id: r for r in out}
    for doc, text in texts:
        if doc is not None and sum(d == doc for d, _ in texts) == 1:
            words, r = (text or "").split(), by_id[doc]
            assert sum(s.end - s.start for s in r.removed) == r.n_removed
            kept = [w for i, w in enumerate(words) if not any(s.start <= i < s.end for s in r.removed)]
            assert len(kept) == r.n_words - r.n_removed


def test_substring_dedup_removes_from_larger_ids_only(table):
    passage = " ".join(f"w{i}" for i in range(20))
    out = {r.doc_id: r for r in substring_dedup(table([(9, "x " + passage), (2, passage + " y"), (5, passage)])).collect()}
    assert (out[2].n_removed, out[5].n_removed, out[9].n_removed) == (0, 20, 20)
    assert out[9].kept_text == "x"


def test_suffix_array_of_random_strings():
    rnd = random.Random(5)
    for k in range(1500):
        s = [rnd.randrange(rnd.randint(1, 5)) for _ in range(rnd.randint(1, 40))]
        if k % 3 == 0:
            s = (s[: rnd.randint(1, 5)] * 40)[: len(s)]
        assert suffix_array(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_rows_are_ordered_by_suffixes():
    rows = np.random.default_rng(1).integers(1, 3, (300, 30)).astype(np.uint8)
    rows[100:150] = rows[:50]
    rows[5, 20:] = 0
    ordered = rows[row_order(rows, 8)]
    assert [bytes(r) for r in ordered] == sorted(bytes(r) for r in rows)
    common = common_prefixes(ordered)
    assert all(common[i] == next((k for k in range(30) if ordered[i][k] != ordered[i - 1][k]), 30) for i in range(1, 300))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 20))
def test_sliding_least(values, size):
    got = sliding_least(np.array(values, np.uint64), size).tolist()
    assert got == [min(values[i : i + size]) for i in range(len(values) - size + 1)]


@pytest.mark.parametrize(("length", "gram", "hot"), [(400, 64, HOT), (60, 16, HOT), (30, 30, HOT), (24, 1, HOT), (400, 64, 0), (60, 16, 0), (60, 16, 3), (24, 1, 5)])
def test_suffix_dedup(table, texts, length, gram, hot):
    rows = [*texts, (4000, "ab" * 300), (4001, "\0" * 70 + "z" + "\0" * 70), (4002, "é" * 200 + "abc")]
    out = suffix_dedup(table(rows), length=length, gram=gram, hot=hot).collect()
    assert grouped((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == brute.suffix_dedup(rows, length)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed and len(r.removed) == r.n_spans for r in out)


def test_frequent_lines_with_different_text_around_them(table):
    """A line shorter than the strings and a longer one in a third of the documents each, and copies."""
    rnd = random.Random(6)
    own = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    short, long = own(300), own(450)
    copy = own(900)
    rows = []
    for i in range(3000):
        middle = short if i % 3 == 0 else long if i % 3 == 1 else own(100)
        rows.append((i, copy if i % 100 == 7 else own(rnd.randint(0, 500)) + middle + own(rnd.randint(0, 500))))
    out = suffix_dedup(table(rows).repartition(8), hot=100).collect()
    assert grouped((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == brute.suffix_dedup(rows, 400)
    assert {r.n_removed for r in out if r.doc_id % 3 == 0 and r.doc_id % 100 != 7} == {0}
    assert min(r.n_removed for r in out if r.doc_id % 3 == 1) >= 450


def test_suffix_dedup_within_one_document(table):
    part = "".join(chr(97 + (i * i) % 26) + str(i) for i in range(140))
    (row,) = suffix_dedup(table([(1, part + "---" + part)])).collect()
    assert row.n_removed == 2 * len(part) and bytes(row.kept) == b"---"


@pytest.mark.parametrize(("min_chars", "min_docs"), [(40, 5), (1, 2), (10, 3)])
def test_line_dedup(table, texts, min_chars, min_docs):
    out = line_dedup(table(texts), min_chars=min_chars, min_docs=min_docs)
    assert {"chunk", "bucket", "text_hash", "score"} <= set(out.columns)
    got = grouped((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect() if r.doc_id is not None)
    want = brute.line_dedup(texts, min_chars, min_docs)
    want.pop(None)
    assert got == want
    unnamed = [(r.n_lines, r.n_dropped, r.text) for r in out.where("doc_id IS NULL").collect()]
    assert len(unnamed) == 2 and all(n is None and d is None for n, d, _ in unnamed)


def test_a_line_of_most_documents_crosses_partitions(spark, table):
    line = "a line that very many documents hold, as long as it needs"
    rows = [(i, f"own line of document number {i:05d} with enough characters\n{line}\n{line.upper()}") for i in range(3000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = {r.doc_id: r.n_dropped for r in line_bitmaps(table(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(out) == 3000 and out.pop(2999) == 0 and set(out.values()) == {2}


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup, line_dedup])
def test_empty_table(table, operator):
    assert operator(table([]).limit(0)).count() == 0
    assert operator(table([(None, "x")])).count() == (1 if operator is line_dedup else 0)


def test_slices_and_words_keep_to_documents():
    import pyarrow as pa

    column = pa.array(["ab cd", None, "", "ef", " gh\x1cij\x0b k"])
    (lo, hi, buf, offsets), *rest = slices(column)
    words = Words(buf, offsets)
    assert not rest and (lo, hi) == (0, 5)
    assert [bytes(buf[s:e]) for s, e in zip(words.start, words.end)] == [b"ab", b"cd", b"ef", b"gh\x1cij", b"k"]
    assert words.doc.tolist() == [0, 0, 3, 4, 4]
    assert [(a, b) for a, b, *_ in slices(column, 3)][0] == (0, 1)


def test_rows_of_one_id_are_dealt_over_chunks(table):
    rows = [(1, f"text number {i}") for i in range(64)]
    assert chunked(table(rows), "doc_id", "text", 8).select("chunk").distinct().count() == 8


def test_sizes_behind_joins_are_measured(table, spark):
    docs = table([(i, "text" * 10) for i in range(50)]).select("doc_id", "text")
    joined = docs.join(spark.range(0, 10_000, 1, 2).withColumnRenamed("id", "doc_id").hint("merge"), "doc_id")
    assert stored_bytes(joined) == 50 * 40
    assert stored_bytes(spark.range(1000).selectExpr("id", "CAST(id AS string) AS text")) > 0
