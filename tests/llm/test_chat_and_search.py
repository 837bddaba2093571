"""Chat prefix trees and exact search."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tallyflow.llm.chat_tree import ROOT, chat_tree, format_turn, parse_turn, read_back, unescape
from tallyflow.llm.impact_search import Index, top_k

CONTROL = st.lists(st.sampled_from(["\\", "###", "</turn>", "### assistant: ", ": ", "#", "<", "\n", "a", "é", " "]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(CONTROL, CONTROL)
def test_turns_read_back(role, text):
    segment, a, b = format_turn(role, text)
    assert parse_turn(segment) == (role, text) and unescape(segment[a:b]) == text


@pytest.fixture(scope="module")
def conversations():
    rnd = random.Random(9)
    openings = [("system", f"rules {k}") for k in range(3)]
    rows = []
    for c in range(120):
        turns = [rnd.choice(openings)] if rnd.random() < 0.8 else []
        for t in range(rnd.choice([0, 1, 2, 3, 6])):
            turns.append(("user" if t % 2 == 0 else "assistant", rnd.choice(["yes", "no </turn>", "\\### assistant: ", "", "né"])))
        rows += [(c * 7, t, role, text) for t, (role, text) in enumerate(turns)]
    rows += [(10_000, t, "assistant", f"turn {t}") for t in range(300)] + [(10_001, t, "assistant", f"turn {t}") for t in range(150)]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    rows += [(20_000, None, "assistant", "first"), (20_000, 1, None, None), (20_000, 1, "a", "tie"), (20_000, 1, "a", "tie"), (None, 0, "user", "x")]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def packed(spark, conversations):
    df = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string")
    for name in ("node", "depth", "tree", "owner"):
        df = df.withColumn(name, F.lit("x"))
    return chat_tree(df)


def paths_of(conversations):
    out = defaultdict(list)
    for c, t, role, text in sorted((r for r in conversations if r[0] is not None), key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        out[c].append((role or "", text or ""))
    return out


def test_conversations_read_back(packed, conversations):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, turns in paths_of(conversations).items():
        loss = "".join(x for r, x in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), sum(len(format_turn(r, x)[0]) for r, x in turns))
    assert {r[0]: tuple(r[1:]) for r in read_back(*packed).collect()} == want


def test_streams_are_depth_first_and_see_their_ancestors(packed, conversations):
    nodes = [r.asDict() for r in packed[0].collect()]
    by_name = {bytes(r["node"]): r for r in nodes}
    prefixes = {tuple(turns[: k + 1]) for turns in paths_of(conversations).values() for k in range(len(turns))}
    assert len(nodes) == len(by_name) == len(prefixes)
    trees = defaultdict(list)
    for r in nodes:
        trees[r["tree"]].append(r)
    for rows in trees.values():
        at, open_ = 0, []
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["end"] - r["start"] == len(r["segment"])
            at = r["end"]
            while open_ and open_[-1] != bytes(r["parent"]):
                open_.pop()
            assert open_ or bytes(r["parent"]) == ROOT
            open_.append(bytes(r["node"]))
            above = [by_name[n] for n in open_[:-1]]
            seen = [i for a in above for i in range(a["start"], a["end"])]
            assert [i for s in r["attends"] for i in range(s["start"], s["end"])] == seen and r["position"] == len(seen)
            if r["loss_start"] is not None:
                role, text = parse_turn(r["segment"])
                assert role == "assistant" and unescape(r["segment"][r["loss_start"] - r["start"] : r["loss_end"] - r["start"]]) == text
    assert max(len(r["attends"]) for r in nodes if r["owner"] >= 10_000) <= 2


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    packed, paths = chat_tree(empty)
    assert packed.count() == 0 and read_back(packed, paths).count() == 0


def expected(rows, is_query, k, scale=256.0):
    vectors = [(i, np.floor(scale * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    out = set()
    for q in sorted({i for i, _ in vectors if is_query(i)}):
        best = {}
        for qi, a in vectors:
            for i, b in vectors:
                if qi == q and i != q and len(a) == len(b):
                    best[i] = max(best.get(i, -(10**18)), int(a @ b))
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, rank, i, s))
    return out


def test_top_k(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(12)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2050, [None] + [0.1] * 11), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (2200, []), (2250, [0.0] * 12), (2300, [0.5, 0.5]), (2350, [0.1, -0.5]), (None, [0.1] * 12)]
    rows += [(100, rows[7][1]), (333, rows[9][1]), (333, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("x")).withColumn("score", F.lit(1))
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k in (5, 1, 500):
        got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 50 == 0, k).collect()}
        assert got == expected(single, lambda i: i % 50 == 0, k)
    assert top_k(df.limit(0), F.lit(True)).count() == 0


def test_index_stops_only_on_proof():
    """Whatever the level at which processing stops, the best are those of a full scan."""
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(0, 40, (600, 16)).astype(int)
    vectors[300:310] = vectors[5]
    index = Index(np.arange(600), vectors)
    for q in range(0, 600, 20):
        at, scores = index.top(q, vectors[q], 7)
        full = vectors @ vectors[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-full[i], i))[:7]
        assert index.ids[at].tolist() == want and scores.tolist() == [full[i] for i in want]


def test_large_components_take_part(spark):
    """256 * 1e8 is beyond 32 bits; products beyond 64 bits are an error."""
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1.0, 0.0]), (1, [1e8, 0.0]), (2, [2.0, 0.0]), (3, [-1e8, 1.0]), (4, [math.inf, 0.0]), (5, [math.nan, 0.0])]
    got = top_k(spark.createDataFrame(rows, schema), F.col("vec_id") == 0, k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    for large in (1e12, 1e300):
        with pytest.raises(Exception, match="64-bit products"):
            top_k(spark.createDataFrame([(0, [large]), (1, [large])], schema), F.col("vec_id") == 0).collect()
