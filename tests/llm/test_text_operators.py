"""Token counts, sentence pieces, decontamination and toxicity."""

import pickle
import random
import re

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tallyflow.llm.decontaminate import PASSAGE, Probes, contaminated, decontaminate
from tallyflow.llm.lexicon import LevenshteinAutomaton, Lexicon
from tallyflow.llm.sentence_pieces import PieceModel, decode, double_array, encode, encode_slice
from tallyflow.llm.token_counts import token_counts
from tallyflow.llm.toxicity import Hit, ToxicityModel, features, fit, fold, quoted, score_toxicity
from tokenizers import Tokenizer

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "B", "é", "é", " ", "  ", "\t", "\n", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "12", "²", "中", "̈", "​", " ", "Σ", "İ", "-", "...", "😀", "\x0b", "\x1c", "\x85", "▁", "<0x0A>", "</s>"]


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(1)
    return [(i, "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 40)))) for i in range(600)]


def test_token_counts(table, texts, odd_texts):
    rows = [*texts, *((10_000 + i, t) for i, t in odd_texts), (9000, "word" * 40_000)]
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = sorted((d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for d, t in rows if d is not None)
    assert sorted(map(tuple, token_counts(table(rows), WORD_BPE).collect())) == want


def test_token_counts_refuses_tokenizers_that_see_white_space(table):
    with pytest.raises(ValueError):
        token_counts(table([(1, "a")]), public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_of_an_empty_table(table):
    assert token_counts(table([]).limit(0), WORD_BPE).count() == 0


@pytest.fixture(scope="module")
def model():
    m = PieceModel(PIECES)
    m.lists = (m.trie.base.tolist(), m.trie.check.tolist(), m.trie.value.tolist(), m.scores.tolist())
    return m


def encoded(model, texts):
    data = [t.encode() for t in texts]
    ids, at = encode_slice(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]), model)
    return [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:])]


def test_double_array_holds_its_keys_only():
    rnd = random.Random(2)
    keys = {bytes(rnd.choice(b"ab\xff") for _ in range(rnd.randint(1, 6))): i for i in range(200) for _ in [0]}
    trie = double_array(keys)

    def find(key):
        node = 0
        for c in key:
            child = int(trie.base[node]) + c
            if trie.check[child] != node:
                return -1
            node = child
        return int(trie.value[node])

    assert all(find(k) == v for k, v in keys.items())
    assert all(find(k) == keys.get(k, -1) for k in (bytes(rnd.choice(b"abc\xff") for _ in range(rnd.randint(1, 7))) for _ in range(500)))


def test_best_paths(model, odd_texts):
    by_text = {t: i for i, t in enumerate(model.texts) if len(t) and i not in set(model.bytes.tolist())}
    words = ["the", "distinguishing", "naïve", "中文字", "x\ny", "   deep", "a" * 30, "zq" * 50] + [t.replace(" ", "") for _, t in odd_texts[:150]]
    for word, got in zip(words, encoded(model, words), strict=True):
        data = b" " + word.encode() if word else b""
        parts = [p for p in __import__("re").findall(rb" +[^ ]*", data)]
        total, ids = 0.0, []
        for part in parts:
            score, own = brute.best_path(part, model.scores, model.unknown, model.bytes.tolist(), by_text)
            total, ids = total + score, ids + own
        assert got == ids


def test_best_paths_are_those_of_the_public_library(model):
    """The library finds the same best path when told that the pieces are a unigram model's."""
    raw = open(PIECES, "rb").read()
    at = raw.rindex(b"\x12\x06tok_v0\x18\x02") + 9
    library = SentencePieceProcessor(model_proto=raw[:at] + b"\x01" + raw[at + 1 :])
    words = ["the", "thermal", "distinguish", "Überraschung", "queréis", "loan", "engineering", "ontology", "mentiroso", "pqrst"]
    assert encoded(model, words) == [library.nbest_encode_as_ids(w, 3)[0] for w in words]


def test_round_trip(spark, table, texts, odd_texts):
    rows = [*texts, *((10_000 + i, t) for i, t in odd_texts)]
    out = decode(encode(table(rows).withColumn("piece_ids", F.lit("old")), PIECES), PIECES)
    assert {"chunk", "score"} <= set(out.columns)
    got = [(r.doc_id, r.text, r.decoded, r.piece_ids) for r in out.select("doc_id", "text", "decoded", "piece_ids").collect()]
    assert len(got) == len(rows) and all(text == back for _, text, back, _ in got)
    assert all((ids is None) == (text is None) and (text != "" or ids == []) for _, text, _, ids in got)
    assert encode(table([]).limit(0), PIECES).count() == 0


@pytest.fixture(scope="module")
def benchmark_items():
    rnd = random.Random(3)
    return [(i, "".join(rnd.choice("abcdeé 中\n") for _ in range(rnd.choice([10, 24, 30, 60, 96, 97, 150, 300])))) for i in range(25)] + [(90, None), (91, "")]


@pytest.fixture(scope="module")
def suspects(benchmark_items):
    rnd = random.Random(4)
    junk = lambda n: "".join(rnd.choice("abcdeé 中\n") for _ in range(n))
    rows = []
    for k in range(90):
        text = list(rnd.choice(benchmark_items[:25])[1])
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 8])):
            p, how = rnd.randrange(len(text)), rnd.random()
            if how < 0.35:
                text[p] = rnd.choice("abcde")
            elif how < 0.7:
                del text[p]
            else:
                text.insert(p, "x")
        text = "".join(c.upper() if c in "abcde" and k % 2 else c for c in text)
        rows.append((k, junk(rnd.randint(0, 60)) + text[rnd.choice([0, 0, 30]) :] + junk(rnd.randint(0, 60))))
    items = dict(benchmark_items)
    return [*rows, (200, None), (201, ""), (202, items[4] * 3), (203, items[4] + items[5]), (204, junk(300)), (204, items[6]), (None, items[7])]


@pytest.mark.parametrize(("block_bytes", "passage"), [(1 << 20, PASSAGE), (900, PASSAGE), (1 << 20, None)])
def test_contaminated(spark, table, benchmark_items, suspects, block_bytes, passage):
    items = spark.createDataFrame(benchmark_items, "item_id long, text string")
    got = sorted(map(tuple, contaminated(table(suspects), items, block_bytes=block_bytes, passage=passage).collect()))
    want = sorted((d, item, e) for d, t in suspects if d is not None for item, e in brute.held_items(t, benchmark_items, passage=passage).items())
    assert got == want and len({e for _, _, e in want}) > (2 if passage else 3)


def test_decontaminate_keeps_clean_rows_as_they_are(spark, table, benchmark_items, suspects):
    items = spark.createDataFrame(benchmark_items, "item_id long, text string")
    docs = table(suspects)
    out = decontaminate(docs, items)
    assert out.columns == docs.columns
    want = [(d, t) for d, t in suspects if not brute.held_items(t, benchmark_items)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, want))
    assert decontaminate(table([]).limit(0), items).count() == 0
    assert decontaminate(docs, items.limit(0)).count() == len(suspects)


def test_every_passage_of_an_item_is_found():
    """Against all substrings of an item, whole and with two edits, and with one word in ten replaced."""
    rnd = random.Random(8)
    words = lambda n, letters: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(4, 8))) for _ in range(n))
    items = [(0, words(40, "abcdefgh")), (1, words(12, "abcdefgh"))]
    probes = Probes(items, 12, 96, 24, 0.05, PASSAGE)

    def found(texts):
        data = [t.encode() for t in texts]
        doc, item, _ = probes.find(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]))
        return list(zip(doc.tolist(), item.tolist(), strict=True))

    for item, text in items:
        for size in (PASSAGE, 61, 95):
            cut = [text[at : at + size] for at in range(len(text) - size + 1)]
            quotes = [words(9, "uvwxyz") + " " + x + words(9, "uvwxyz") for x in cut]
            assert found(quotes) == [(k, item) for k in range(len(cut))]
        cut = [list(text[at : at + PASSAGE]) for at in range(len(text) - PASSAGE + 1)]
        for x in cut:
            x[rnd.randrange(25)], x[25 + rnd.randrange(25)] = "", "z"
        assert found(["zz" + "".join(x) + "zz" for x in cut]) == [(k, item) for k in range(len(cut))]
    changed = items[0][1].split()
    changed[4::10] = ["uvwxyz"] * len(changed[4::10])
    assert found([" ".join(changed)]) == [(0, 0)]
    assert found([items[0][1][20:55] + words(9, "uvwxyz"), words(60, "uvwxyz")]) == []


def test_probes_of_nothing():
    probes = Probes([(1, "short")], 12, 96, 24, 0.05)
    assert [len(x) for x in probes.find(np.frombuffer(b"some text", np.uint8), np.array([0, 9]))] == [0, 0, 0]


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
        before = row
    return before[-1]


def test_levenshtein_automaton():
    rnd = random.Random(1)
    for _ in range(4000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7))) for _ in range(2))
        edits = rnd.randint(0, 2)
        automaton = LevenshteinAutomaton(a, edits)
        state = automaton.start()
        for letter in b:
            state = automaton.step(state, letter)
        assert automaton.distance(state) == (distance(a, b) if distance(a, b) <= edits else None)


def test_lexicon():
    lexicon = Lexicon({"disgusting": 5.0, "moron": 4.0}, {"lowei": 3.0}, frozenset({"oron"}))
    assert lexicon.look_up("moron") == ("moron", 4.0, 0)
    assert lexicon.look_up("morron") == ("moron", 2.0, 1)
    assert lexicon.look_up("disgustin") == ("disgusting", 2.5, 1)
    assert lexicon.look_up("loweispx") == ("lowei*", 3.0, 0)
    assert lexicon.look_up("oron") is None and lexicon.look_up("other") is None and lexicon.look_up("") is None


def _lexicon(rnd, letters, n):
    word = lambda a, b: "".join(rnd.choice(letters) for _ in range(rnd.randint(a, b)))
    terms = {word(3, 16): 1 + rnd.random() for _ in range(n)}
    return Lexicon(terms, {word(4, 8): 1 + rnd.random() for _ in range(8)}, frozenset(w[1:] for w in list(terms)[::9]))


def _misspelled(rnd, word, letters):
    word = list(word)
    for _ in range(rnd.randint(0, 3)):
        p, how = rnd.randrange(len(word) + 1), rnd.randint(0, 2)
        word[p : p + (how > 0)] = [rnd.choice(letters)] if how < 2 else []
    return "".join(word)


def test_look_up_of_many_words_equals_that_of_each():
    rnd = random.Random(3)
    letters = "abcdeéσ中😀s"
    lexicon = _lexicon(rnd, letters, 300)
    words = ["", *{_misspelled(rnd, rnd.choice(list(lexicon.terms)), letters) for _ in range(600)}, *{_misspelled(rnd, "a" * 12, letters) for _ in range(50)}]
    got = lexicon.look_up_all(words)
    assert got == {w: hit for w in words if (hit := lexicon.look_up(w))} and len(got) > 150
    assert lexicon.look_up_all([]) == {} and Lexicon({}, {}).look_up_all(["a", "abcdefghijkl"]) == {}
    for w in words:
        hit = brute.lexicon_hit(w, lexicon.terms, lexicon.stems, lexicon.innocent)
        assert (got.get(w) and (got[w][1], got[w][0], got[w][2])) == hit


def test_hits_of_a_table_equal_brute_force(table):
    """Every word of every text against every term by its edit distance."""
    rnd = random.Random(5)
    letters = "abcdé"
    lexicon = _lexicon(rnd, letters, 60)
    forms = [str.upper, str.title, str, lambda w: f"({w},", lambda w: w + "-" + w, lambda w: '"' + w + '"']
    rows = [(i, " ".join(rnd.choice(forms)(_misspelled(rnd, rnd.choice(list(lexicon.terms)), letters)) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (101, rows[0][1]), (102, rows[1][1] * 50), (None, rows[2][1])]
    model = ToxicityModel(lexicon, np.array([0.5] * 6 + [-1.0]))
    want = []
    for d, text in rows:
        hits = []
        for place, token in enumerate(brute.WORD.findall((text or "").encode())):
            for w in re.findall(r"[^\W_]+", token.decode().lower()):
                if hit := brute.lexicon_hit(w, lexicon.terms, lexicon.stems, lexicon.innocent):
                    hits.append((hit[1], w, place, hit[2]))
        want.append((d, text, hits))
    out = score_toxicity(table(rows).repartition(3), model, score="p").collect()
    got = [(r.doc_id, r.text, [(h.term, h.word, h.place, h.edits) for h in r.toxic_hits]) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(bool(w[2]) for w in want) > 40
    for r in out:
        own = [Hit(h.term, h.word, h.place, h.edits, h.quoted, lexicon.look_up(h.word)[1]) for h in r.toxic_hits]
        z = float(np.dot(model.coefficients, [*features(own), 1.0]))
        assert r.p == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


def test_misspellings_of_all_terms_of_a_large_lexicon():
    rnd = random.Random(9)
    terms = {"".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(5, 9))): 1.0 + k for k, _ in enumerate(range(3000))}
    lexicon = pickle.loads(pickle.dumps(Lexicon(terms, {})))
    for term in rnd.sample(sorted(terms), 300):
        at = rnd.randrange(len(term))
        for word in (term[:at] + term[at + 1 :], term[:at] + "z" + term[at + 1 :], term[:at] + "z" + term[at:]):
            near = [(w, weight / 2, 1) for w, weight in terms.items() if distance(w, word) == 1] if at == 0 else None
            got = lexicon.look_up(word)
            assert got is not None and (near is None or word in terms or got == max(near, key=lambda x: (x[1], x[0])))


def test_two_edits_are_found_wherever_they_are():
    rnd = random.Random(12)
    assert Lexicon({"disgusting": 4.0}, {}).look_up("dizgustinq") == ("disgusting", 1.0, 2)
    for term in ("disgusting", "abominations", "contemptibleness"):
        lexicon = Lexicon({term: 4.0}, {})
        for _ in range(500):
            word = list(term)
            for _ in range(2):
                at, how = rnd.randrange(len(word)), rnd.random()
                word[at : at + (how < 0.7)] = rnd.choice("dzq") if how > 0.3 else ""
            d = distance(term, "".join(word))
            assert lexicon.look_up("".join(word)) == (term, 4.0 * 0.5**d, d)


def test_misspelled_terms_do_not_depend_on_rank(spark, table):
    """A hundred toxic words, each found misspelled in a document that holds nothing else."""
    rnd = random.Random(10)
    word = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    toxic, clean = sorted({word("abcdefgh", 7) for _ in range(100)}), sorted({word("klmnopqr", 6) for _ in range(300)})
    rows = [(i, " ".join([*rnd.sample(clean, 25), *(rnd.sample(toxic, 20) if i % 2 else [])])) for i in range(800)]
    docs = table([*rows, *((9000 + k, f"{w[:3]}z{w[3:]}") for k, w in enumerate(toxic))])
    out = score_toxicity(docs, fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")))
    got = {r.doc_id: [(h.term, h.edits) for h in r.toxic_hits] for r in out.where("doc_id >= 9000").collect()}
    assert got == {9000 + k: [(w, 1)] for k, w in enumerate(toxic)}


def test_quotation():
    assert quoted('he wrote "you idiot', 'idiot" to me', "idiot")
    assert quoted("the word idiot", "idiot is old", "idiot")
    assert not quoted('a "nice" idiot', "idiot here", "idiot")
    assert not quoted("you idiot", "idiot", "idiot")


@pytest.fixture(scope="module")
def labelled():
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefghik") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    insults = ["wretch", "villainous", "blockhead"] * 13 + ["snark" + rnd.choice(vocabulary) for _ in range(40)]
    rows, labels = [], []
    for i in range(1500):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rnd.randint(2, 5)):
                words.insert(rnd.randrange(len(words)), rnd.choice(insults))
        elif i % 29 == 0:
            words[2:2] = ["the", "word", '"wretch"', "means"]
        rows.append((i, " ".join(words)))
        if i % 5 != 1:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark, table, labelled):
    rows, labels = labelled
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (7, 5)], "doc_id long, toxic int")
    odd = [(90_000, None), (90_001, ""), (90_002, "you villainnous wretchh blockhead"), (90_003, 'he said "wretch" once'), (90_002, "fine")]
    docs = table([*rows, *odd])
    model = fit(docs, marks)
    out = score_toxicity(docs, model, score="score").withColumn("held_out", fold(F.col("doc_id")) == 0)
    assert {"chunk", "bucket", "toxic_hits"} <= set(out.columns)
    got = out.collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.5, r.doc_id % 6 == 0) for r in got if r.held_out and r.doc_id < 90_000]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.98
    by_id = {(r.doc_id, r.text): r for r in got}
    assert by_id[90_002, odd[2][1]].score > 0.5 > by_id[90_003, odd[3][1]].score
    assert any(h.edits for h in by_id[90_002, odd[2][1]].toxic_hits) and by_id[90_003, odd[3][1]].toxic_hits[0].quoted
    assert by_id[90_000, None].score == by_id[90_001, ""].score < 0.5


def test_held_out_labels_are_not_learned(spark, table, labelled):
    rows, labels = labelled
    import zlib

    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels]
    docs = table(rows)
    first, second = (fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert first.lexicon.terms == second.lexicon.terms and np.array_equal(first.coefficients, second.coefficients)


def test_toxicity_without_labels(spark, table):
    docs = table([(1, "a"), (2, None)])
    for rows in ([], [(1, 1)]):
        model = fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert len({r.toxicity for r in score_toxicity(docs, model).collect()}) == 1
    assert score_toxicity(table([]).limit(0), model).count() == 0
