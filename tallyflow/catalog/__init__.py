"""Registered queries over the test tables, each with the SQL that must give the same result."""

from tallyflow.catalog import anomalies, health, imports, income, plans, spending, streams, tasks, texts
from tallyflow.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "anomalies", "health", "imports", "income", "plans", "spending", "streams", "tasks", "texts"]
