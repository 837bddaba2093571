"""What a task holds is bounded: fewer aggregates in one stage, and joins in pieces by stored size."""

from __spark_entry__ import queries
from pyspark.sql import functions as F
from tallyflow.functions.categorize import type_from_column
from tallyflow.operators import spending
from tallyflow.sources import star

SF = "/root/testdata/sf0.001"


def test_spending_summary_shuffles_twice(spark, make_ledger):
    """By the grouping sets and by user; there is no aggregate by category and month before them."""
    ledger = make_ledger([(1, "income", "Pay", 10, "2024-01-01"), (1, "expense", "Food", 3, "2024-01-01"), (2, "income", "Pay", 5, "2024-02-01")])
    summary = spending.spending_summary(ledger)
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    rows = {r["user_id"]: r for r in summary.collect()}
    assert {k: float(v) for k, v in rows[1]["category_spending"].items()} == {"Food": 3.0}
    assert rows[2]["monthly_trends"] == {} and float(rows[2]["total_expenses"]) == 0.0


def test_join_of_lines_goes_by_stored_size(spark, monkeypatch):
    def rows(df):
        return sorted(str(r) for r in df.collect())

    whole = [rows(f(spark, SF)) for f in (star.star_ledger, star.debts, star.statement_rows)]
    monkeypatch.setattr(star, "PIECE_BYTES", 5_000)
    lines, orders = star.lines_of_orders(spark, SF)
    n = star.stored_bytes(spark, f"{SF}/lineitem.parquet") // 5_000
    assert n >= star.MANY_PIECES and lines.rdd.getNumPartitions() == orders.rdd.getNumPartitions() == n
    assert [rows(f(spark, SF)) for f in (star.star_ledger, star.debts, star.statement_rows)] == whole


def test_large_documents_of_few_row_groups_are_spread(spark, monkeypatch):
    """One row group is one task; eight cores share its rows."""
    query, sf = queries()["type_inference"], "/root/testdata/sf0.01"
    whole = sorted(map(str, query(spark, sf).collect()))
    assert star.documents(spark, sf).rdd.getNumPartitions() == 1
    monkeypatch.setattr(star, "PIECE_BYTES", 50_000)
    monkeypatch.setattr(star, "MANY_PIECES", 4)
    spread = star.documents(spark, sf)
    held = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) >= 16 and max(held) < sum(held) / 4
    assert sorted(map(str, query(spark, sf).collect())) == whole


def test_type_inference_lowers_a_text_once(spark):
    plan = queries()["type_inference"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1


def test_type_of_a_lowered_column(spark):
    rows = spark.createDataFrame([("Income",), ("CREDIT note",), ("debit",), ("",), (None,)], "v string").withColumn("t", F.lower("v"))
    own, given = type_from_column(F.col("v")), type_from_column(F.col("v"), F.col("t"))
    assert rows.filter(own != given).count() == 0 and rows.filter(given == "income").count() == 2
