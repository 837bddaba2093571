"""The corpus pipeline against its stages' plain versions, and the registered queries."""

import os
import random

import brute
import corpus_pipeline
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tallyflow.llm.queries import ORACLES, QUERIES
from tallyflow.llm.toxicity import fit, score_toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and a benchmark that give every stage something to do."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefgéü") for _ in range(rnd.randint(2, 9))) for _ in range(600)]
    words = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, words(25)) for k in range(6)]
    line = "This frequent line stands in many documents of the corpus."
    docs, labels = [], []
    for i in range(240):
        text = words(rnd.randint(20, 90))
        if i % 8 == 0:
            text += " blockhead " + words(5) + " wretch " + words(3) + " villainous"
        elif i % 10 == 1:
            text += "\n" + line + "\n" + words(10)
        elif i % 30 == 2:
            text += " " + items[i % 6][1] + " " + words(4)
        elif i % 12 == 3 and docs:
            text = docs[-1][1] + " tail" if i % 24 == 3 else docs[-1][1]
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 1, int(i % 8 == 0)))
    docs += [(500, None, None, None, None), (501, "", "en", "src0", 0), (None, words(30), "en", "src1", 5)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_pipeline(spark, corpus):
    folder, docs, items = corpus
    given = spark.read.parquet(f"{folder}/documents.parquet")
    scored = score_toxicity(given, fit(given, spark.read.parquet(f"{folder}/labels.parquet")))
    toxic = {r.doc_id for r in scored.where("toxicity >= 0.5").collect()}
    assert toxic == {d for d, *_ in docs if d is not None and d < 240 and d % 8 == 0 and d % 24 != 3}
    rows = [(d, t) for d, t, *_ in docs if d not in toxic]
    named = [(d, t) for d, t in rows if d is not None]
    named = [(d, kept) for d, v in brute.line_dedup(named).items() for _, _, kept in v]
    groups, _ = brute.near_duplicates(named, corpus_pipeline.NEAR_PERCENT)
    assert any(d != g for d, g in groups.items())
    rest = [(d, t) for d, t in named if groups[d] == d] + [(d, t) for d, t in rows if d is None]
    want = [(d, t) for d, t in rest if not brute.held_items(t, items)]
    assert len(want) < len(rest)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece_ids"]
    got = out.collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, want))
    assert all(r.n_chars == len(r.text) for r in got)
    texts = SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECE_MODEL))
    assert all(texts.decode(r.piece_ids) == r.text for r in got)


def test_stages_keep_the_columns_of_documents(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), folder)
        assert empty.columns == docs.columns and empty.count() == 0


def test_queries_cover_all_thirteen_operators():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_over_the_smallest_tables(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.count() > 0
    assert not [c for c, kind in out.dtypes if kind == "void"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    from compare import differences, duck

    assert differences(spark, duck(SF), SF, QUERIES[name], ORACLES[name]) == []


def test_no_operator_names_a_local_folder():
    """Intermediate tables belong in the shared folder; local checkpoints have one copy only."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = os.path.join(root, "tallyflow", "llm")
    for path in [*(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".py")), os.path.join(root, "corpus_pipeline.py")]:
        with open(path) as file:
            source = file.read()
        assert "tempfile" not in source and "localCheckpoint" not in source
