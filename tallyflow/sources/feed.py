"""Bank feed: normalising added rows and importing only those the ledger does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyflow.functions.money import to_money

SAME = ["user_id", "description", "amount", "ts"]


def active_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.filter("is_active")


def normalise_feed(feed: DataFrame) -> DataFrame:
    """Feed rows as ledger rows. The feed counts spending as positive, so the sign is read the other way round
    and zero is an income. The category is the first of a list, or Other.
    """
    first = F.when(F.size("category") > 0, F.element_at("category", 1))
    return feed.select(
        "user_id",
        "seq",
        F.col("name").alias("description"),
        to_money(F.abs("amount")).alias("amount"),
        F.coalesce(first, F.lit("Other")).alias("category"),
        F.when(F.col("amount") > 0, "expense").otherwise("income").alias("txn_type"),
        F.col("date").cast("timestamp_ntz").alias("ts"),
    )


def new_rows(feed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Normalised feed rows (with `seq`, their arrival order) that are not in the ledger yet.

    Same user, description, amount and date is the same transaction, also within the feed, where the first one
    counts. Copies are cut to one row per task before the shuffle on all four columns, on both sides, so neither
    a large user nor a large group of copies gathers anywhere.
    """
    first = Window.partitionBy(*SAME).orderBy("seq")
    distinct = feed.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    return distinct.join(ledger.select(*SAME).distinct(), SAME, "left_anti")


def observed_import(feed: DataFrame, ledger: DataFrame, write) -> dict[str, int]:
    """Import the new rows with `write(rows)`, one action, and return how many rows were seen and how many imported.

    Both numbers are observed while that action runs, so nothing is read again for the report.
    """
    seen, imported = Observation(), Observation()
    count = F.count(F.lit(1))
    fresh = new_rows(feed.observe(seen, count.alias("total")), ledger)
    write(fresh.observe(imported, count.alias("imported")))
    return {**seen.get, **imported.get}


def sync_report(feed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows seen and rows imported, by user."""
    seen = feed.groupBy("user_id").agg(F.count("*").alias("total"))
    imported = new_rows(feed, ledger).groupBy("user_id").agg(F.count("*").alias("imported"))
    return seen.join(imported, "user_id", "left").withColumn("imported", F.coalesce("imported", F.lit(0)))
