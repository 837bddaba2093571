"""Rules as a table: the automaton against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from tallyflow.functions.categorize import with_category
from tallyflow.functions.rule_table import RULES, Automaton, rule_table, with_table_category


def first_rule(text, kind, rules):
    """Index of the first rule that matches, -1 if none does."""
    fits = lambda r: r[0] in (None, kind) and any(w in text for w in r[1]) and not any(w in text for w in r[2])
    return next((i for i, r in enumerate(rules) if fits(r)), -1)


@pytest.mark.parametrize("seed", range(4))
def test_automaton_equals_plain_search(seed):
    rnd = random.Random(seed)
    letters = "aab😀é "
    word = lambda n: "".join(rnd.choice(letters) for _ in range(rnd.randint(0 if rnd.random() < 0.01 else 1, n)))
    rules = [(rnd.choice([None, "x", "y"]), [word(6) for _ in range(rnd.randint(0, 3))], [word(9) for _ in range(rnd.choice([0, 0, 2]))]) for _ in range(60)]
    texts = [word(40) for _ in range(300)] + ["", "zz", "b" * 2000, "q" * 509 + "aab aab" + "q" * 600, "q" * 511 + "😀é"]
    kinds = [rnd.choice(["x", "y", "other", None]) for _ in texts]
    got = Automaton(rules).first_rules(texts, kinds).tolist()
    assert got == [first_rule(t, k, rules) for t, k in zip(texts, kinds, strict=True)]
    assert len(set(got)) > 3


def test_automaton_of_no_rules_and_no_texts():
    assert Automaton([]).first_rules(["a", ""], ["x", None]).tolist() == [-1, -1]
    assert Automaton([(None, ["a"], [])]).first_rules([], []).tolist() == []


def descriptions(spark):
    words = "Monthly SALARY,gas bill,auto insurance,Insurance premium,car wash,shell gas,hospital,animal hospital,PAYMENT,bus lunch,,gift,zzz,amazon prime".split(",")
    rows = [(i, w if w else None, kind) for i, (w, kind) in enumerate((w, k) for w in words for k in ("income", "expense"))]
    return spark.createDataFrame(rows, "id int, description string, txn_type string")


@pytest.mark.parametrize("block_letters", [100_000, 40, 1])
def test_own_rules_as_a_table(spark, block_letters):
    """As the CASE expression says, in one block or many."""
    rows = descriptions(spark).withColumn("_own", F.when(F.col("id") % 5 == 0, "Mine"))
    want = with_category(rows, own_category="_own")
    got = with_table_category(rows, rule_table(spark), own_category="_own", block_letters=block_letters)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_ten_thousand_rules(spark):
    rnd = random.Random(9)
    word = lambda a, b: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(a, b)))
    rules = [(rnd.choice([None, "income", "expense"]), [word(5, 9), word(4, 9)], [word(2, 3)] if i % 10 == 0 else []) for i in range(10_000)]
    table = [(i * 3, kind, f"c{i}", w, gone) for i, (kind, words, absent) in enumerate(rules) for gone, some in ((False, words), (True, absent)) for w in some]
    rnd.shuffle(table)
    texts = [(i, word(0, 60), rnd.choice(["income", "expense"])) for i in range(300)] + [(900, None, "income"), (901, "x", None)]
    df = spark.createDataFrame(texts, "id int, description string, txn_type string").repartition(3)
    got = {r["id"]: r["category"] for r in with_table_category(df, spark.createDataFrame(table, RULES).repartition(5)).collect()}
    for i, text, kind in texts:
        rule = first_rule(text or "", kind, rules)
        assert got[i] == (f"c{rule}" if rule >= 0 else "Other Income" if kind == "income" else "Other")
    assert sum(c.startswith("c") for c in got.values()) > 100
    none = spark.createDataFrame([], RULES)
    assert {r["category"] for r in with_table_category(df, none).collect()} == {"Other Income", "Other"}


@pytest.mark.parametrize("seed", range(2))
def test_joined_rules_equal_plain_search(spark, seed):
    """Words of any length, empty ones, pieces in many words, absent words and types, without a block that reads all texts."""
    rnd = random.Random(seed)
    letters = "aab😀é "
    word = lambda a, n: "".join(rnd.choice(letters) for _ in range(rnd.randint(a, n)))
    texts = [word(0, 90) for _ in range(300)] + ["", "zz", "b" * 200, "x" * 99]
    part = lambda: (lambda t, a: t[a : a + rnd.choice([2, 5, 8, 9, 16, 17, 40, 70])])(rnd.choice(texts), rnd.randint(0, 20))
    rules = [(rnd.choice([None, "x", "y"]), [part() or "zz" for _ in range(rnd.randint(0, 3))], [word(1, 4) for _ in range(rnd.choice([0, 0, 2]))]) for _ in range(60)]
    rules += [("y", [""], ["aa", "zz"]), ("x", [""], [""]), ("x", ["b" * 150, "x" * 64], []), (None, ["x" * 30], ["x" * 100])]
    rows = [(i, rnd.choice(["x", "y", "other", None]), t) for i, t in enumerate(texts)]
    table = [(i, kind, f"c{i}", w, gone) for i, (kind, words, absent) in enumerate(rules) for gone, some in ((False, words), (True, absent)) for w in some]
    df = spark.createDataFrame(rows, "id int, txn_type string, description string").repartition(3)
    got = {r["id"]: r["category"] for r in with_table_category(df, spark.createDataFrame(table, RULES), most_blocks=0).collect()}
    for i, kind, text in rows:
        rule = first_rule(text, kind, rules)
        assert got[i] == (f"c{rule}" if rule >= 0 else "Other"), (text, kind)
    assert len(set(got.values())) > 10


def test_many_rules_are_no_chain_of_passes(spark):
    """A hundred blocks of rules would read all texts a hundred times."""
    rules = spark.range(2000).selectExpr("id AS rule_no", "CAST(NULL AS STRING) AS txn_type", "concat('c', id) AS category", "concat('name#', id) AS word", "false AS absent")
    df = spark.range(50).selectExpr("concat('by Name#', 40 * id) AS description", "'income' AS txn_type", "40 * id AS id")
    out = with_table_category(df, rules, block_letters=150)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") < 5
    names = {r["id"]: r["category"] for r in out.collect()}
    assert names[0] == "c0" and names[40] == "c4" and names[1960] == "c1"


def test_texts_are_read_in_slices(spark):
    """The automaton holds many bytes a letter, so a batch of long texts goes through it in parts."""
    from tallyflow.functions.word_hits import SLICE, slices

    assert list(slices(["a" * 5, "b" * 5, "", "c" * 30, "d"], 10)) == [(0, 3), (3, 4), (4, 5)] and list(slices([])) == []
    texts = ["x" * (SLICE // 4) + ("salary" if i % 2 else "") for i in range(12)]
    df = spark.createDataFrame([(i, t, "income") for i, t in enumerate(texts)], "id int, description string, txn_type string").coalesce(1)
    got = {r["id"]: r["category"] for r in with_table_category(df, rule_table(spark)).collect()}
    assert {got[i] for i in range(0, 12, 2)} == {"Other Income"} and len({got[i] for i in range(1, 12, 2)} - {"Other Income"}) == 1
