"""Registration, output columns and the SQL of the source views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.money import round_to, wall_micros
from tallyflow.sources.star import HOUSEHOLD_NAMES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with its SQL if there is one."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return register


# ---- output columns: exact money and rounded statistics as double, counts as bigint, times as text ----


def money(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("double").alias(alias or name.split(".")[-1])


def num(name: str, digits: int = 6, alias: str | None = None) -> Column:
    return round_to(F.col(name), digits).alias(alias or name.split(".")[-1])


def big(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("bigint").alias(alias or name.split(".")[-1])


def day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def micros(name: str) -> Column:
    return wall_micros(name).alias(name)


def star_keys() -> list[Column]:
    """The parts of the star ledger's id that a reader knows: order, line, part, supplier."""
    names = ("order_key", "line_number", "part_key", "supp_key")
    return [F.col(f"txn_id.k{i}").alias(n) for i, n in enumerate(names, 1)]


# ---- the same in SQL ----------------------------------------------------------------------------------


def r(expr: str, digits: int = 6) -> str:
    return f"(floor(CAST({expr} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits})"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def rat(top: str, bottom: str) -> str:
    """top / bottom, 0 unless bottom is above zero."""
    return f"(CASE WHEN {dbl(bottom)} > 0 THEN {dbl(top)} / {dbl(bottom)} ELSE 0.0 END)"


STAR = """ledger AS (
  SELECT o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderpriority AS category,
         'income' AS txn_type, o_orderdate AS ts, o_orderkey AS k1, 0::BIGINT AS k2, 0::BIGINT AS k3, 0::BIGINT AS k4
  FROM orders
  UNION ALL
  SELECT o_custkey, CAST(l_extendedprice AS DECIMAL(18,2)), p_type, 'expense', l_shipdate,
         l_orderkey, l_linenumber::BIGINT, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HOUSEHOLD_NAMES.items())
HOUSEHOLD = STAR.replace("ledger AS", "star AS") + f""",
ledger AS (SELECT * REPLACE (CASE category {_CASES} ELSE category END AS category) FROM star)"""

EVENTS = """ledger AS (
  SELECT event_id AS txn_id, user_id, CAST(value AS DECIMAL(18,2)) AS amount, event_type AS category,
         'expense' AS txn_type, ts FROM events)"""

MIXED = """ledger AS (
  SELECT event_id AS txn_id, user_id, CAST(value AS DECIMAL(18,2)) AS amount, event_type AS category,
         CASE WHEN event_type IN ('signup', 'purchase') THEN 'income' ELSE 'expense' END AS txn_type, ts FROM events)"""

STRETCHED = MIXED.replace(
    "ts FROM events", "TIMESTAMP '2024-01-01' + to_microseconds(20 * date_diff('microsecond', TIMESTAMP '2024-01-01', ts)) AS ts FROM events"
)

PROFILES = """profiles AS (
  SELECT c_custkey AS user_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'gig' WHEN 'HOUSEHOLD' THEN 'informal' ELSE 'formal' END AS employment_type,
         CASE WHEN c_acctbal < 0 THEN 'conservative' WHEN c_acctbal < 5000 THEN 'moderate'
              WHEN c_acctbal < 9000 THEN 'aggressive' ELSE 'high' END AS risk_tolerance
  FROM customer)"""

MONTHS = """months AS (
  SELECT user_id, txn_type, date_trunc('month', ts) AS month, SUM(amount) AS total, COUNT(*) AS n
  FROM ledger GROUP BY ALL),
series AS (
  SELECT *, CAST(total AS DOUBLE) AS y,
         CAST(row_number() OVER (PARTITION BY user_id, txn_type ORDER BY month) - 1 AS DOUBLE) AS x FROM months)"""

METRICS = MONTHS + f""",
sums AS (
  SELECT user_id,
         COALESCE(SUM(total) FILTER (txn_type = 'income'), 0) AS total_income,
         COALESCE(SUM(total) FILTER (txn_type = 'expense'), 0) AS total_expenses,
         COUNT(*) FILTER (txn_type = 'income') AS income_months,
         COUNT(*) FILTER (txn_type = 'expense') AS expense_months,
         COALESCE(stddev_samp(y) FILTER (txn_type = 'income'), 0) AS sd,
         COALESCE(stddev_pop(y) FILTER (txn_type = 'income'), 0) AS sd_pop,
         CAST(SUM(total) FILTER (txn_type = 'income') AS DOUBLE) / nullif(COUNT(*) FILTER (txn_type = 'income'), 0) AS mean
  FROM series GROUP BY user_id),
metrics AS (
  SELECT sums.*, {rat('total_income - total_expenses', 'total_income')} AS savings_rate,
         {rat('total_expenses', 'total_income')} AS expense_ratio,
         {rat('sd', 'mean')} AS volatility, {rat('sd_pop', 'mean')} AS volatility_pop,
         employment_type, risk_tolerance, COALESCE(employment_type IN ('gig', 'informal'), FALSE) AS irregular
  FROM sums LEFT JOIN profiles USING (user_id))"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
