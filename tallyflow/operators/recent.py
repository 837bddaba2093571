"""Latest rows per user, listings in API shape and the recent summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.money import is_expense, is_income, sum_where
from tallyflow.operators.skew import newest_chunk, rank_within


def latest_rows(rows: DataFrame, k: int, key: str = "user_id", ts: str = "ts", tie: str = "txn_id") -> DataFrame:
    """The k latest rows of each user, ties by id.

    The rank filter becomes a group limit on both sides of the shuffle: no task receives more than k rows of a
    user from any one upstream task.
    """
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return rows.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= k)


def newest_first(rows: DataFrame, users: DataFrame | None = None, ts: str = "ts", tie: str = "txn_id", chunk_by: str = "month") -> DataFrame:
    """A listing per user: `position` 1 is the newest row, ties by id; of the users in the frame `users`, or of all.

    Users ask for their own list only, so nothing is sorted across users; a user's rows are numbered by calendar chunk (`chunk_by`),
    each from the number of rows in the chunks after it, so a user of any size is many small sorts. Rows without a time come last.
    """
    if users is not None:
        rows = rows.join(users.select("user_id").distinct(), "user_id", "left_semi")
    order = [F.col(ts).desc(), F.col(tie).desc()]
    return rank_within(rows, "user_id", newest_chunk(ts, chunk_by), order, "position")


def api_rows(ledger: DataFrame) -> DataFrame:
    """Transactions in API shape, dates as ISO text; the position in a listing is kept if there is one.

    A ledger without descriptions gives NULL ones.
    """
    kept = [c for c in ("position",) if c in ledger.columns]
    described = "description" in ledger.columns
    return ledger.select(
        F.col("txn_id").alias("id"),
        "user_id",
        F.col("amount").cast("double").alias("amount"),
        "category",
        F.col("description") if described else F.lit(None).cast("string").alias("description"),
        F.col("txn_type").alias("transaction_type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        *kept,
    )


def recent_summary(ledger: DataFrame, k: int = 20) -> DataFrame:
    """Income, expenses and net of each user's latest 20 rows."""
    amount = F.col("amount")
    out = latest_rows(ledger.select("user_id", "ts", "txn_id", "txn_type", "amount"), k).groupBy("user_id").agg(
        F.count("*").alias("n_rows"),
        sum_where(is_income(), amount).alias("recent_income"),
        sum_where(is_expense(), amount).alias("recent_expenses"),
    )
    return out.withColumn("net_income", F.col("recent_income") - F.col("recent_expenses"))
