"""The insight feed: up to five insights per user, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import fixed_values as fv
from tallyflow.functions.categorize import category_in
from tallyflow.functions.money import MONEY, is_expense, is_income, present
from tallyflow.operators.anomaly import change_percent, recent_and_unusual
from tallyflow.operators.recent import latest_rows
from tallyflow.operators.skew import SPLIT_ROWS

MIN_ROWS = 3


def insight_inputs(ledger: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """One row per user with every number the insights need.

    Two reads of the ledger: one aggregate by user and category, and the recent and unusual expenses.
    """
    cells = ledger.groupBy("user_id", "category").agg(
        F.sum(F.when(is_income(), F.col("amount"))).alias("income"),
        F.sum(F.when(is_expense(), F.col("amount"))).alias("spent"),
        F.count_if(is_income()).alias("n_income"),
        F.count_if(is_expense()).alias("n_spent"),
    )
    cells = cells.withColumn("mean", F.col("spent").cast("double") / F.nullif(F.col("n_spent"), F.lit(0)))
    tip = category_in(F.col("category"), fv.BUDGET_TIP_CATEGORIES) & (F.col("mean") > 100)
    zero = F.lit(0).cast(MONEY)
    # Largest spending first, ties by name: the smallest (-spent, category) of the user's categories.
    ranked = F.min(F.when(F.col("n_spent") > 0, F.struct((-F.col("spent")).alias("minus"), "category")))
    per_user = cells.groupBy("user_id").agg(
        F.sum(F.col("n_income") + F.col("n_spent")).alias("n_rows"),
        F.sum("n_income").alias("n_income"),
        F.sum("n_spent").alias("n_expense"),
        F.coalesce(F.sum("income"), zero).alias("total_income"),
        F.coalesce(F.sum("spent"), zero).alias("total_expenses"),
        ranked.alias("top"),
        F.min(F.when(tip, F.struct("category", "mean"))).alias("tip"),
    )
    return per_user.join(recent_and_unusual(ledger, split_rows), "user_id", "left")


def _insight(rank: int, kind: str, priority: Column | str, value: Column, subject: Column | None = None, amount: Column | None = None, count: Column | None = None) -> Column:
    metrics = F.struct(
        (amount if amount is not None else F.lit(None)).cast("double").alias("amount"), (count if count is not None else F.lit(None)).cast("bigint").alias("count")
    )
    return F.struct(
        F.lit(rank).alias("rank"),
        F.lit(kind).alias("insight_type"),
        (priority if isinstance(priority, Column) else F.lit(priority)).alias("priority"),
        value.cast("double").alias("value"),
        (subject if subject is not None else F.lit(None).cast("string")).alias("subject"),
        metrics.alias("metrics"),
    )


def insight_feed(ledger: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """user_id, rank, insight_type, priority, value, subject, metrics. Below three rows only a welcome.

    `value` is the number behind the insight: a share, rate, change or mean, or the largest unusual amount; `metrics` are the other
    numbers that its sentence needs.
    """
    return _insights_of(insight_inputs(ledger, split_rows))


def _insights_of(inputs: DataFrame) -> DataFrame:
    spent = F.col("total_expenses").cast("double")
    share = F.when(spent != 0, -F.col("top.minus").cast("double") / spent * 100.0)
    income = F.col("total_income").cast("double")
    saved = (F.col("total_income") - F.col("total_expenses")).cast("double")
    savings = F.when(income > 0, saved / income * 100.0).otherwise(0.0)
    both = (F.col("n_income") > 0) & (F.col("n_expense") > 0)
    change = change_percent(F.col("recent_total"), F.col("previous_total"))
    compared = (F.col("n_recent") > 0) & (F.col("n_previous") > 0)

    kinds = present(
        F.when(
            share > 30,
            _insight(1, "spending_pattern", F.when(share > 50, "high").otherwise("medium"), share, F.col("top.category"), -F.col("top.minus")),
        ),
        F.when(both & (savings < 10), _insight(2, "savings_alert", "high", savings)),
        F.when(both & (savings >= 20), _insight(2, "savings_success", "low", savings)),
        F.when(compared & (F.abs(change) > 20), _insight(3, "trend_alert", "medium", change)),
        F.when(
            F.col("n_unusual") > 0,
            _insight(4, "anomaly_detection", "medium", F.col("largest_unusual"), F.col("unusual_category"), count=F.col("n_unusual")),
        ),
        F.when(F.col("tip").isNotNull(), _insight(5, "recommendation", "low", F.col("tip.mean"), F.col("tip.category"))),
    )
    welcome = F.array(_insight(0, "welcome", "low", F.lit(None)))
    chosen = F.when(F.col("n_rows") < MIN_ROWS, welcome).otherwise(kinds)
    return inputs.select("user_id", F.inline(chosen))


def insight_text(feed: DataFrame) -> DataFrame:
    """Add `content`, the sentence shown. For display only: it rounds half up."""
    kind, value, subject = F.col("insight_type"), F.col("value"), F.col("subject")
    amount, count = F.col("metrics.amount"), F.col("metrics.count")
    content = (
        F.when(kind == "welcome", "Add transactions to see insights about your spending, savings and financial health.")
        .when(kind == "spending_pattern", F.format_string("%s takes %.1f%% of your expenses, %.2f in all.", subject, value, amount))
        .when(kind == "savings_alert", F.format_string("You save %.1f%% of your income; aim for 20%%.", value))
        .when(kind == "savings_success", F.format_string("You save %.1f%% of your income. Well done.", value))
        .when(kind == "trend_alert", F.format_string("Spending changed by %+.1f%% against the 30 days before.", value))
        .when(kind == "anomaly_detection", F.format_string("%d unusually large, the largest %.2f in %s.", count, value, subject))
        .when(kind == "recommendation", F.format_string("%s averages %.2f a time; set a limit.", subject, value))
    )
    return feed.withColumn("content", content)


def latest_insights(insights: DataFrame, k: int = 20) -> DataFrame:
    """The newest insights of each user; within one set the later written first."""
    return latest_rows(insights, k, ts="created_at", tie="insight_id")


def missing_insights(ledger: DataFrame, users: DataFrame, insights: DataFrame) -> DataFrame:
    """Insights for the users that have none yet. Users without any transaction get the welcome.

    The per-user numbers are small, so users are chosen among them and not in the ledger; idle users come out of the same join.
    """
    lacking = users.select("user_id").distinct().join(insights.select("user_id").distinct(), "user_id", "left_anti")
    inputs = lacking.join(insight_inputs(ledger), "user_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return _insights_of(inputs)
