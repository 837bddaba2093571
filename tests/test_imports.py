"""Statements, categories, the bank feed and stored tables."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tallyflow.functions import fixed_values as fv
from tallyflow.functions.categorize import parse_rules, with_category
from tallyflow.operators import advice
from tallyflow.sources import feed, ledger, statement
from tallyflow.streaming.ingest import import_batch


@pytest.mark.parametrize("kind, text, category", [
    ("income", "ACH PAYMENT", "Salary"),  # 'pay' makes every income payment a salary
    ("income", "Quarterly Dividend", "Investment"),
    ("income", "cash", "Other Income"),
    ("expense", "BUSINESS LUNCH", "Transportation"),  # 'bus' comes before 'lunch'
    ("expense", "ANIMAL HOSPITAL", "Healthcare"),  # 'hospital' hides 'animal hospital'
    ("expense", "GAS BILL 12", "Utilities"),
    ("expense", "SHELL OIL", "Transportation"),
    ("expense", "Amazon Prime", "Entertainment"),
    ("expense", "amazon.com", "Shopping"),
    ("expense", "LIFE INSURANCE", "Insurance"),
    ("expense", "CARE INSURANCE", "Other"),  # 'car' excludes it
    ("expense", "T-Mobile", "Utilities"),
    ("expense", "", "Other"),
    ("expense", None, "Other"),
])
def test_first_rule_wins(spark, kind, text, category):
    df = spark.createDataFrame([(text, kind)], "description string, txn_type string")
    assert with_category(df).first()["category"] == category


def test_every_word_reaches_its_rule_or_an_earlier_one(spark):
    rules = parse_rules()
    words = [(w, r.txn_type, i) for i, r in enumerate(rules) for w in r.words]
    out = with_category(spark.createDataFrame(words, "description string, txn_type string, i int")).collect()
    order = [r.category for r in rules]
    for row in out:
        earlier = {order[j] for j in range(row["i"] + 1)} | ({"Other"} if row["description"] == "insurance" else set())
        assert row["category"] in earlier


def test_own_category_wins(spark):
    df = spark.createDataFrame([("rent", "expense", "Mine"), ("rent", "expense", None)], "description string, txn_type string, own string")
    assert [r["category"] for r in with_category(df, own_category="own").collect()] == ["Mine", "Housing"]


ROWS = [
    ("01/05/2024", "Payroll", "1000.00"), ("2024-01-06", "Rent", "-500"), ("13/45/2024", "Cafe", "-3.5"), ("", "Cafe", "-3"),
    ("01/07/2024", "Odd", "$1,234.50"), ("01/08/2024", "Blank", ""), ("01/09/2024", "Cashback", "0"), ("01/09/2024", "Zero", "0"),
    ("01/10/2024", None, "-1"), ("13/01/2024", "Day first", " 7 "),
]


@pytest.fixture
def normalised(spark):
    raw = spark.createDataFrame([(*r, "f.csv", i) for i, r in enumerate(ROWS)], "Date string, Description string, Amount string, file string, line bigint")
    return statement.normalise(raw, statement.default_mapping(["Date", "Description", "Amount"]), "2030-01-01")


def test_normalise(normalised):
    good = {r["description"]: r for r in statement.good_rows(normalised).collect()}
    assert set(good) == {"Payroll", "Rent", "Cafe", "Cashback", "Zero", "", "Day first"}
    assert good["Payroll"]["txn_type"] == "income" and good["Payroll"]["category"] == "Salary"
    assert float(good["Rent"]["amount"]) == 500.0 and good["Rent"]["txn_type"] == "expense"
    assert good["Cafe"]["ts"] == dt.datetime(2030, 1, 1)  # unreadable date becomes as_of
    assert (good["Cashback"]["txn_type"], good["Zero"]["txn_type"]) == ("income", "expense")
    assert good["Day first"]["ts"] == dt.datetime(2024, 1, 13)


def test_row_errors_are_numbered(normalised):
    assert sorted((r["row"], r["error"][:7]) for r in statement.row_errors(normalised).collect()) == [(4, "no date"), (5, "could n"), (6, "could n")]


def test_row_errors_of_every_file_are_complete(spark, tmp_path):
    """Files of several blocks, each with more errors than a screen holds."""
    columns = ["Date", "Description", "Amount"]
    want = set()
    for f in range(3):
        lines = []
        for i in range(400):
            bad = i % 17 == f
            lines.append(f"01/05/2024,row {i} of file {f} with some more text,{'bad' if bad else '1.00'}")
            if bad:
                want.add((f"{f}.csv", i + 1))
        (tmp_path / f"{f}.csv").write_text("\n".join([",".join(columns), *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        raw = statement.read_statements(spark, str(tmp_path), columns)
        assert raw.select("file", "block").distinct().count() > 9
        found = statement.row_errors(statement.normalise(raw, statement.default_mapping(columns), "2030-01-01")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r["file"].rsplit("/")[-1], r["row"]) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize(("text", "want"), [
    ("05/01/2024 10:30 PM", "2024-05-01 22:30:00"), ("05/01/2024 12:05 am", "2024-05-01 00:05:00"), ("05/01/2024 12:00 p.m.", "2024-05-01 12:00:00"),
    ("05/01/99", "1999-05-01 00:00:00"), ("05/01/68", "2068-05-01 00:00:00"), ("05/01/69", "1969-05-01 00:00:00"), ("2024-Jan-05", "2024-01-05 00:00:00"),
    ("Jan 05 2024 3:04 PM", "2024-01-05 15:04:00"), ("5 January 2024", "2024-01-05 00:00:00"), ("05-Jan-24", "2024-01-05 00:00:00"), ("Sept. 3, 2023", "2023-09-03 00:00:00"),
    ("20240105", "2024-01-05 00:00:00"), ("2024/01/05 07:08:09", "2024-01-05 07:08:09"), ("2024-01-05T07:08:09", "2024-01-05 07:08:09"), ("31.12.2023", "2023-12-31 00:00:00"),
    ("13/45/2024", None), ("30/02/2024", None), ("05/01/2024 13:00 PM", None), ("05/01/2024 25:00", None), ("soon", None), ("", None), ("Foo 5 2024", None), ("2024-13-01", None),
])
def test_dates(spark, text, want):
    row = statement.with_date(spark.createDataFrame([(text,)], "t string").withColumn("t", F.col("t")), F.col("t"), "d").first()
    assert row["d"] == (dt.datetime.fromisoformat(want) if want else None)


def test_headers_of_banks():
    assert statement.default_mapping(["Posting Date", "Merchant", "Debit", "Credit", "Balance"]) == {"date": "Posting Date", "description": "Merchant", "debit": "Debit", "credit": "Credit"}
    assert statement.default_mapping(["Date", "Payee", "Amount", "Credit"]) == {"date": "Date", "description": "Payee", "amount": "Amount"}
    assert statement.default_mapping(["Value date", "Particulars", "Withdrawal Amount", "Deposit Amount"]) == {"date": "Value date", "description": "Particulars", "debit": "Withdrawal Amount", "credit": "Deposit Amount"}


def test_debit_and_credit(spark):
    rows = [("5.00", None), ("-5", " "), (None, "7"), ("", ""), ("2", "3"), ("x", None), ("x", "1")]
    raw = spark.createDataFrame(rows, "Debit string, Credit string").withColumn("Date", F.lit("2024-01-01")).withColumn("Merchant", F.lit("Shop"))
    out = statement.normalise(raw, statement.default_mapping(raw.columns), "2030-01-01").collect()
    got = [(r["txn_type"], None if r["amount"] is None else float(r["amount"]), r["error"]) for r in out]
    assert got[:3] == [("expense", 5.0, None), ("expense", 5.0, None), ("income", 7.0, None)] and got[4] == ("income", 1.0, None)
    assert [g[2].split(": ")[1] for g in got if g[2]] == [repr(""), repr("x"), repr("x 1")]


def test_import_summary(normalised):
    row = statement.import_summary(statement.good_rows(normalised)).first()
    assert (row["total_transactions"], row["income_count"], row["expense_count"]) == (7, 3, 4)
    assert float(row["savings"]) == 1007.0 - 504.5


def test_type_column_beats_the_sign(spark):
    raw = spark.createDataFrame([("-5", "Credit"), ("5", "Debit"), ("5", None)], "Amount string, Type string").withColumn("Date", F.lit("2024-01-01"))
    out = statement.normalise(raw, statement.default_mapping(raw.columns), "2030-01-01")
    assert [r["txn_type"] for r in out.collect()] == ["income", "expense", "expense"]


def test_statement_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Description,Amount,Balance\n01/05/2024,"Rent, May",-5.00,1\n01/06/2024,"two\nlines",bad,1\n')
    (tmp_path / "b.csv").write_text("Date,Description,Amount,Balance\n01/05/2024,Salary,7,1\n")
    raw = statement.read_statements(spark, str(tmp_path), multi_line=True)
    out = statement.normalise(raw, statement.default_mapping(raw.columns), "2030-01-01")
    assert {r["description"] for r in statement.good_rows(out).collect()} == {"Rent, May", "Salary"}
    assert [r["row"] for r in statement.row_errors(out).collect()] == [2]


def test_confirmed_rows(spark):
    rows = spark.createDataFrame([(1, "5.50", "x", "d", "expense", "2024-01-05"), (1, "1", "x", "d", "income", "01/05/2024")],
                                 "user_id bigint, amount string, category string, description string, type string, date string")
    assert [r["ts"] for r in statement.confirmed(rows, "2030-01-01").collect()] == [dt.datetime(2024, 1, 5), dt.datetime(2030, 1, 1)]


FEED = "user_id bigint, seq bigint, name string, amount double, date date, category array<string>"
DAY = dt.date(2024, 1, 5)
FEED_ROWS = [
    (1, 0, "Shop", 5.0, DAY, ["Food", "x"]), (1, 1, "Shop", -5.0, DAY, ["Later"]), (1, 2, "Pay", -9.0, DAY, []),
    (1, 3, "Nil", 0.0, DAY, None), (2, 4, "Shop", 5.0, DAY, ["Food"]),
]


def test_feed_signs_and_duplicates(spark):
    rows = feed.normalise_feed(spark.createDataFrame(FEED_ROWS, FEED))
    stored = rows.filter("user_id = 2")
    new = {r["description"]: (r["txn_type"], r["category"]) for r in feed.new_rows(rows, stored).collect()}
    assert new == {"Shop": ("expense", "Food"), "Pay": ("income", "Other"), "Nil": ("income", "Other")}
    assert {r["user_id"]: (r["total"], r["imported"]) for r in feed.sync_report(rows, stored).collect()} == {1: (4, 3), 2: (1, 0)}


def test_import_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    batch = spark.createDataFrame(FEED_ROWS, FEED)
    for _ in range(2):
        import_batch(batch, path)
    stored = ledger.read_ledger(spark, path)
    assert stored.count() == 4
    one = spark.createDataFrame([(1,)], "user_id bigint")
    assert ledger.read_ledger(spark, path, one, txn_type="income", months=("2024-01", "2024-01")).count() == 2


def test_ledger_month_is_a_partition(spark, tmp_path, make_ledger):
    path = str(tmp_path / "ledger")
    ledger.append_ledger(make_ledger([(1, "expense", "x", 1, "2024-01-31"), (1, "expense", "x", 1, "2024-02-01")]), path)
    one = ledger.read_ledger(spark, path, months=("2024-02", "2024-12"))
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(month" in one._jdf.queryExecution().toString()


def test_replacing_insights_keeps_other_users(spark, tmp_path):
    path = str(tmp_path / "insights")
    schema = "user_id bigint, insight_type string"
    ledger.append_insights(spark.createDataFrame([(u, "old") for u in range(50)], schema), path)
    ledger.replace_insights(
        spark.createDataFrame([(3, "new"), (3, "newer")], schema), spark.createDataFrame([(3,), (4,)], "user_id bigint"), path
    )
    rows = sorted(tuple(r) for r in ledger.read_insights(spark, path).collect())
    assert rows == sorted([(u, "old") for u in range(50) if u not in (3, 4)] + [(3, "new"), (3, "newer")])


def test_advice_lists(spark):
    texts = [('["a", "b"]',), ('{"a": 1}',), ("7",), ("- one \n* two *\n  - indented\nplain\n•three\n-\n-6\n-7",), (None,), ("",)]
    out = [r["advice"] for r in advice.with_advice_list(spark.createDataFrame(texts, "text string")).collect()]
    assert out == [["a", "b"], list(fv.NON_LIST_ADVICE), list(fv.NON_LIST_ADVICE), ["one", "two", "three", "", "6", "7"], list(fv.FAILED_ADVICE), []]
    first = advice.with_advice_list(spark.createDataFrame([("- Save more\r\n*\tCut costs\n- x\n- y",)], "text string"), most=2).first()
    assert first["advice"] == ["Save more", "Cut costs"]


def test_recommendations_from_text_and_json(spark):
    texts = [("My advice:  save more! RECOMMENDATION spend less. no end",), ('[{"action": "x", "priority": "low"}]',), ("nothing",)]
    out = [r["recommendations"] for r in advice.with_recommendations(spark.createDataFrame(texts, "text string")).collect()]
    assert [r["action"] for r in out[0]] == ["save more!", "spend less."]
    assert (out[1][0]["action"], out[1][0]["priority"], out[1][0]["impact"]) == ("x", "low", None)
    assert out[2] == []


def test_money_is_exact(spark):
    from tallyflow.functions.money import to_money

    values = [0.0, 0.29, 1.15, 19.99, 123456.78, 99999999.99]
    out = spark.createDataFrame([(v,) for v in values], "v double").select(to_money(F.col("v")).alias("m")).collect()
    assert [r["m"] for r in out] == [decimal.Decimal(str(v)).quantize(decimal.Decimal("0.01")) for v in values]
