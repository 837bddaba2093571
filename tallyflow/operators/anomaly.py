"""Outliers by category, unusual transactions, spending spikes, spending trend and income gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions import moments
from tallyflow.functions.money import is_expense, is_income
from tallyflow.operators.recent import latest_rows
from tallyflow.operators.skew import SPLIT_ROWS, attach_group_stats, with_carried_rows

ORDER = ["ts", "txn_id"]


def _amount_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    n, s, q = moments.sums(F.col("amount"))
    return rows.groupBy(*keys).agg(n.alias("n"), s.alias("s"), q.alias("q"), F.max("amount").alias("largest"))


def category_outliers(ledger: DataFrame, times: float = 3.0, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Expenses above mean + 3 population sd of their user and category; high above 4 sd, else medium.

    Groups below 3 rows are skipped. The largest z a group of n can hold is sqrt(n - 1), so 3 sd needs 11 rows.
    Groups whose largest amount is no outlier are dropped before the statistics meet the rows.
    """
    rows = ledger.filter(is_expense()).select("user_id", "category", "txn_id", "ts", "amount")
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    keys = ["user_id", "category"]
    stats = _amount_sums(rows, keys).filter((n >= 3) & moments.above(F.col("largest"), times, n, s, q)).drop("largest")
    joined = attach_group_stats(rows, stats, keys, "n", ["txn_id"], split_rows, "inner")
    severe = moments.above(F.col("amount"), times + 1.0, n, s, q)
    return joined.filter(moments.above(F.col("amount"), times, n, s, q)).select(
        "user_id",
        "category",
        "txn_id",
        "ts",
        "amount",
        n.alias("n_rows"),
        moments.mean(n, s).alias("mean"),
        moments.sd_pop(n, s, q).alias("sd"),
        F.when(severe, "high").otherwise("medium").alias("severity"),
    )


def expense_profile(ledger: DataFrame) -> DataFrame:
    """Per user: exact sums, largest amount and latest time of the expenses."""
    n, s, q = moments.sums(F.col("amount"))
    return (
        ledger.filter(is_expense())
        .groupBy("user_id")
        .agg(n.alias("n"), s.alias("s"), q.alias("q"), F.max("amount").alias("largest"), F.max("ts").alias("last_ts"))
    )


def recent_and_unusual(ledger: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Per user with expenses: spending of the last and the previous 30 days, and the unusual transactions.

    The last 30 days include both ends, the previous 30 only the start. Unusual: above mean + 2 sample sd over all
    categories, for users with more than 10 expenses. Of equally large ones the earliest names the category.
    One salted join serves both; rows that matter to neither are dropped before the aggregate.
    """
    rows = ledger.filter(is_expense()).select("user_id", "category", "txn_id", "ts", "amount")
    n, s, q, last = F.col("n"), F.col("s"), F.col("q"), F.col("last_ts")
    joined = attach_group_stats(rows, expense_profile(ledger), ["user_id"], "n", ["txn_id"], split_rows, "inner")
    recent = F.col("ts") >= last - F.expr("INTERVAL 30 DAYS")
    previous = (F.col("ts") >= last - F.expr("INTERVAL 60 DAYS")) & ~recent
    unusual = (n > 10) & moments.above(F.col("amount"), 2.0, n, s, q, sample=True)
    marked = joined.select(
        "user_id", "category", "txn_id", "ts", "amount",
        recent.alias("recent"), previous.alias("previous"), unusual.alias("unusual"),
    ).filter(F.col("recent") | F.col("previous") | F.col("unusual"))

    amount = F.col("amount")
    largest_first = F.struct((-amount).alias("minus"), F.col("ts"), F.col("txn_id"), F.col("category"))
    return marked.groupBy("user_id").agg(
        F.count_if(F.col("recent")).alias("n_recent"),
        F.count_if(F.col("previous")).alias("n_previous"),
        F.sum(F.when(F.col("recent"), amount)).alias("recent_total"),
        F.sum(F.when(F.col("previous"), amount)).alias("previous_total"),
        F.count_if(F.col("unusual")).alias("n_unusual"),
        F.max(F.when(F.col("unusual"), amount)).alias("largest_unusual"),
        F.min(F.when(F.col("unusual"), largest_first))["category"].alias("unusual_category"),
    )


def spending_trend(ledger: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Spending of the last 30 days against the 30 before, where both have rows, with the change in percent.

    The change is 0 where the previous spending is not above zero.
    """
    rows = ledger.filter(is_expense()).select("user_id", "txn_id", "ts", "amount")
    last = rows.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    joined = attach_group_stats(rows, last, ["user_id"], "n", ["txn_id"], split_rows, "inner")
    recent = F.col("ts") >= F.col("last_ts") - F.expr("INTERVAL 30 DAYS")
    near = joined.filter(F.col("ts") >= F.col("last_ts") - F.expr("INTERVAL 60 DAYS"))
    out = near.groupBy("user_id").agg(
        F.sum(F.when(recent, F.col("amount"))).alias("recent_total"),
        F.sum(F.when(~recent, F.col("amount"))).alias("previous_total"),
    )
    return out.filter("recent_total IS NOT NULL AND previous_total IS NOT NULL").withColumn(
        "change_percent", change_percent(F.col("recent_total"), F.col("previous_total"))
    )


def change_percent(recent, previous):
    before = previous.cast("double")
    return F.when(before > 0, (recent.cast("double") - before) / before * 100.0).otherwise(0.0)


def spending_spikes(
    ledger: DataFrame, times: float = 2.0, depth: int = 30, chunk_by: str = "month", split_rows: int = SPLIT_ROWS, times_of: DataFrame | None = None
) -> DataFrame:
    """Each expense against its category among the user's latest 30 rows up to it, in date order.

    A spike is above mean + 2 population sd of at least 3 such expenses (itself among them), once the user has 5
    rows. `position` numbers the user's rows; a range of 29 positions within the category is the same set of
    rows as a filter over the last 30, without building an array per row. The rows of a user with more than `split_rows` are
    windowed by runs of calendar chunks (`chunk_by`: month, week, day, ...), each with the 29 rows before it, so a user of any size
    is spread over tasks. `times_of` holds user_id and ts of the same rows, where a narrower plan gives them.
    """
    rows = ledger.select("user_id", "ts", "txn_id", "category", "txn_type", "amount")
    chunk = F.date_trunc(chunk_by, "ts").alias("chunk")
    sizes = (ledger if times_of is None else times_of).select("user_id", chunk)
    framed = with_carried_rows(rows.select("*", chunk), "user_id", ORDER, depth - 1, split_rows, sizes)
    in_order = Window.partitionBy("user_id", "chunk").orderBy(*ORDER)
    same = (
        Window.partitionBy("user_id", "chunk", "category")
        .orderBy("position")
        .rangeBetween(-(depth - 1), Window.currentRow)
    )
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    agg_n, agg_s, agg_q = moments.sums(F.col("amount"))
    placed = framed.withColumn("position", F.row_number().over(in_order)).filter(is_expense())
    measured = placed.withColumns({"n": agg_n.over(same), "s": agg_s.over(same), "q": agg_q.over(same)})
    spikes = measured.filter(
        ~F.col("carried") & (F.col("position") >= 5) & (n >= 3) & moments.above(F.col("amount"), times, n, s, q)
    )
    return spikes.select(
        "user_id", "txn_id", "ts", "category", "amount",
        n.alias("n_rows"), moments.mean(n, s).alias("mean"), moments.sd_pop(n, s, q).alias("sd"),
    )


def income_gaps(ledger: DataFrame, depth: int = 30, alert_days: float = 14.0) -> DataFrame:
    """Mean whole days between successive incomes among each user's latest 30 rows, from 3 incomes on."""
    income = latest_rows(ledger.select("user_id", "ts", "txn_id", "txn_type"), depth).filter(is_income())
    gap = F.timestamp_diff("DAY", F.lag("ts").over(Window.partitionBy("user_id").orderBy(*ORDER)), F.col("ts"))
    per_user = income.withColumn("gap", gap).groupBy("user_id").agg(
        F.count("*").alias("n_incomes"), F.avg("gap").alias("mean_gap_days")
    )
    return per_user.filter("n_incomes >= 3").withColumn("alert", F.col("mean_gap_days") > alert_days)
