"""Every registered query against its SQL in DuckDB, on the smallest test tables."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from tallyflow.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, SF_DIR, QUERIES[name], ORACLES[name]) == []


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "category_spending", "monthly_trends", "total_expenses", "average_monthly"]
    assert df.count() == 150
