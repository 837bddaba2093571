"""Every query of orders or line items against its SQL, where customers lack one thing or another."""

import os

import pytest
from compare import TABLES, differences, duck

from tallyflow.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"

# By the remainder of the customer's key: 0 as they are, 1 no orders at all, 2 income alone, 3 one order with one line, 4 all expenses equal,
# 5 everything on one day, 6 next to no income.
ORDERS = """
SELECT * REPLACE (CASE o_custkey % 7 WHEN 6 THEN 0.01 ELSE o_totalprice END AS o_totalprice,
                  CASE o_custkey % 7 WHEN 5 THEN first_day ELSE o_orderdate END AS o_orderdate)
FROM (SELECT *, min(o_orderdate) OVER () AS first_day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders)
WHERE o_custkey % 7 <> 1 AND (o_custkey % 7 <> 3 OR nth = 1)"""
LINES = """
SELECT l.* REPLACE (CASE o_custkey % 7 WHEN 4 THEN 10 ELSE l_extendedprice END AS l_extendedprice,
                    CASE o_custkey % 7 WHEN 5 THEN first_day ELSE l_shipdate END AS l_shipdate)
FROM (SELECT *, min(l_shipdate) OVER () AS first_day, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nth FROM lineitem) l
JOIN orders ON l_orderkey = o_orderkey
WHERE o_custkey % 7 NOT IN (1, 2) AND (o_custkey % 7 <> 3 OR l.nth = 1)"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = str(tmp_path_factory.mktemp("odd_users"))
    con = duck(SF_DIR)
    for name in TABLES:
        if name not in ("orders", "lineitem"):
            os.symlink(f"{SF_DIR}/{name}.parquet", f"{out}/{name}.parquet")
    orders = f"SELECT * EXCLUDE (first_day, nth) FROM ({ORDERS})"
    lines = f"SELECT * EXCLUDE (first_day, nth) FROM ({LINES})"
    con.execute(f"COPY ({orders}) TO '{out}/orders.parquet' (FORMAT parquet)")
    con.execute(f"COPY ({lines}) TO '{out}/lineitem.parquet' (FORMAT parquet)")
    return out


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if "orders" in ORACLES[n] or "lineitem" in ORACLES[n]))
def test_query_equals_sql_for_odd_users(spark, con, folder, name):
    assert differences(spark, con, folder, QUERIES[name], ORACLES[name]) == []
