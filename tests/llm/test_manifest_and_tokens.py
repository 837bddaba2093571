"""Merkle manifest, token files and importance resampling against plain versions."""

import random
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tallyflow.llm.crc import joined
from tallyflow.llm.importance_resampling import BUCKETS, Features, Head, head_of, resample
from tallyflow.llm.merkle_manifest import FIELDS, ascii_lower, build_manifest, folded, leaf_digest, proof_digest, proofs
from tallyflow.llm.queries import ORACLES
from tallyflow.llm.ranks import ranked
from tallyflow.llm.repair import Grammar
from tallyflow.llm.token_files import Encoder, read_checksums, read_documents, write_tokens
from tokenizers import Tokenizer
from tokenizers.models import WordLevel

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def as_documents(texts, seed=5):
    """Rows with languages of many, eight, nine, one and no documents, and nulls in any column."""
    rnd = random.Random(seed)
    rows = []
    for i, (doc_id, text) in enumerate(texts):
        lang = rnd.choice(["en", "en", "en", "de", "é", None, ""])
        rows.append((doc_id, text, lang, rnd.choice(["a", None, "b:1"]), rnd.choice([None, i])))
    rows += [(5000 + i, "Eight " * i, "eight", "s", i) for i in range(8)]
    rows += [(6000 + i, "NINE", "nine", None, None) for i in range(9)]
    rows += [(7000, "Alone É", "alone", "s", 7), (7000, "Twice", "twice", "s", 1), (7000, "Twice", "twice", "s", 1), (7000, "other", "twice", "s", 1)]
    return rows


def tampered(doc_id, text):
    if doc_id is None or text is None or zlib.crc32(str(doc_id).encode()) % 3:
        return text
    return text.encode().translate(brute.LOWER).decode()


def manifest_rows(spark, docs):
    which = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = leaf_digest(*(ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS))
    manifest = build_manifest(docs.withColumn("changed", F.when(which, changed)), keep=("changed",))
    out = proofs(spark, manifest).withColumn("claim", F.coalesce("changed", "digest"))
    return out.select("doc_id", "digest", "subroot", "root", proof_digest("trail"), folded("claim", "trail"))


def test_manifest(spark, texts):
    rows = as_documents(texts)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit(1)).withColumn("size", F.lit("x")).withColumn("trail", F.lit(0))
    got = sorted(map(tuple, manifest_rows(spark, docs.repartition(7)).collect()), key=repr)
    assert got == brute.merkle(rows, tampered)
    whole = {r[3] for r in got}
    assert len(whole) == 1
    assert {r[5] == r[3] for r in got} == {True, False}


def test_manifest_equals_its_sql(spark, texts, tmp_path):
    rows = as_documents(texts)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root FROM ({ORACLES['op12_merkle_manifest']})").fetchall()
    assert sorted(want, key=repr) == brute.merkle(rows, tampered)


def test_manifest_of_one_and_of_no_rows(spark):
    one = [(1, "A", None, None, None)]
    assert sorted(map(tuple, manifest_rows(spark, spark.createDataFrame(one, SCHEMA)).collect())) == brute.merkle(one, tampered)
    assert manifest_rows(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_changed_row_changes_the_root(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(70)]
    roots = []
    for text in ("text 3", "text 3 "):
        rows[3] = (3, text, "en", "s", 3)
        roots.append(proofs(spark, build_manifest(spark.createDataFrame(rows, SCHEMA))).first()["root"])
    assert roots[0] != roots[1]


def test_ranks_with_a_hot_group_and_equal_rows(spark):
    rows = [("hot", 5, i % 2) for i in range(3000)] + [(f"g{i % 50}", i % 7, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    got = ranked(df.repartition(5), "g", [F.col("x"), F.col("y")], "rank", "size", len(rows)).collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["g"], []).append((r["rank"], r["x"], r["y"], r["size"]))
    for g, own in by_group.items():
        own.sort()
        assert [o[0] for o in own] == list(range(len(own))) and {o[3] for o in own} == {len(own)}
        assert [o[1:3] for o in own] == sorted((x, y) for k, x, y in rows if k == g)


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip_and_random_access(seed):
    rnd = np.random.default_rng(seed)
    kind = [rnd.integers(0, 3, 5000), np.tile(rnd.integers(0, 900, 37), 200), np.full(777, 4), rnd.integers(0, 1000, 3000), np.array([7]), np.repeat(rnd.integers(0, 9, 400), rnd.integers(1, 30, 400))][seed]
    last = rnd.random(len(kind)) < 0.01
    last[-1] = True
    grammar = Grammar.unpack(Grammar.of(kind, last, 1000).pack())
    assert grammar.ids().tolist() == kind.tolist() and grammar.n_ids() == len(kind)
    for _ in range(30):
        a, b = sorted(rnd.integers(0, len(kind) + 1, 2))
        assert grammar.ids(int(a), int(b)).tolist() == kind[a:b].tolist()
    ends = np.cumsum(np.concatenate([np.ones(1000, int), grammar.lengths])[grammar.symbols])
    assert set((np.flatnonzero(last) + 1).tolist()) <= set(ends.tolist())  # no symbol goes on behind a document
    if seed == 1:
        assert len(grammar.symbols) < len(kind) / 5


def test_encoder_equals_the_library():
    rnd = random.Random(8)
    odd = ["a", "Bc", "é", " ", "  ", "\t", "\n", "\r\n", "'s", "'LL", "<|endoftext|>", "#", "12", "²", "中", "\xa0", "　", " ", "\x85", "\x1c", "\x0b", "😀", "ñ", "...", "\x00", "́", "​"]
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["", "x" * 5000, " " * 3000, "long word " * 500]
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    buf = np.frombuffer(b"".join(data), np.uint8)
    encode = Encoder(tokenizer, 2)
    want = [e.ids + [2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from kept pieces
        ids, sizes = encode(buf, offsets)
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        encode._forget()


@pytest.mark.parametrize("shard, block", [(1 << 20, 1 << 21), (300, 700), (50, 64)])
def test_token_files(spark, table, texts, tmp_path, shard, block):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    path = str(tmp_path / "ids")
    write_tokens(table(texts).repartition(3), BYTE_BPE, 2, path, shard_tokens=shard, block_tokens=block)
    got = sorted(map(tuple, read_checksums(spark, path).collect()))
    own = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in texts if d is not None]
    assert sorted((d, n, c) for d, _, n, c in got) == sorted((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in own)
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted(d for d, _ in own)
    some = [3000, 3005, 3010, 9, -1]
    found = sorted((r["doc_id"], list(r["ids"])) for r in read_documents(spark, path, some).collect())
    assert found == sorted((d, i) for d, i in own if d in some)


def test_token_files_of_an_empty_table(spark, table, tmp_path):
    write_tokens(table([]), BYTE_BPE, 2, str(tmp_path / "ids"))
    assert read_checksums(spark, str(tmp_path / "ids")).count() == 0


def test_token_files_refuse_tokenizers_that_join_over_white_space(spark, table, tmp_path):
    whole = Tokenizer(WordLevel({"a b": 0, "[UNK]": 1}, unk_token="[UNK]"))  # a text is one token
    whole.save(str(tmp_path / "whole.json"))
    with pytest.raises(ValueError):
        write_tokens(table([(1, "a")]), str(tmp_path / "whole.json"), 2, str(tmp_path / "ids"))


def test_checksums_of_joined_strings():
    rnd = random.Random(4)
    pairs = [(rnd.randbytes(rnd.randint(0, 9)), rnd.randbytes(rnd.choice([0, 1, 5, 63, 64, 65, 127, 1000, 70_000]))) for _ in range(200)]
    first, second = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = joined(first, second, np.array([len(p[1]) for p in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_features_with_any_head():
    texts = ["The the THE cat, the cat; a-b c3 é É ñandú", "", "x" * 100 + " y " + "z" * 64, "one two", "... \n", "the cat the cat the cat"]
    data = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    heads = [Head.of([], []), Head.of([b"the", b"cat", b"y"], [(b"the", b"cat"), (b"cat", b"the"), (b"no", b"one")]), Head.of([b"one"], [])]
    gains = np.arange(BUCKETS) * 7 - 30_000
    runs = [brute.word_runs(t) for t in texts]
    for head in heads:
        f = Features(buf, offsets, head)
        assert f.n_words.tolist() == [len(w) for w, _ in runs] and f.n_features().tolist() == [len(r) for _, r in runs]
        assert f.totals().tolist() == np.bincount([zlib.crc32(x) % BUCKETS for _, r in runs for x in r], minlength=BUCKETS).tolist()
        assert f.weights(gains).tolist() == [sum(int(gains[zlib.crc32(x) % BUCKETS]) for x in r) for _, r in runs]


def test_head_is_bounded_and_frequent(table, texts):
    head = head_of(table(texts).select("text"), share=0.01)
    assert 0 < len(head.hashes) <= 100 and len(head.pairs) <= 100
    assert len(head_of(table([(1, None), (2, "")]).select("text")).hashes) == 0


def test_resampling(spark, table, texts):
    target = [texts[2][1], "The same Boilerplate line of more than forty characters", None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    want = brute.resampled(texts, target)
    for share in (2.0**-14, 0.02):
        got = resample(table(texts).repartition(3), goal, head_share=share).select("doc_id", "n_features", "weight", "score", "rank").collect()
        # rows of one id and one score may take each other's rank
        assert sorted((tuple(r) for r in got), key=repr) == want
    assert sum(w[4] is not None for w in want) > 2


def test_resampling_of_empty_tables(spark, table, texts):
    none = spark.createDataFrame([], "text string")
    assert resample(table([]), none).count() == 0
    got = resample(table(texts), none).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == brute.resampled(texts, [])
