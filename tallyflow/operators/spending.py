"""Spending: totals, statistics, monthly trends, concentration, high-spending days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.money import MONEY, is_expense, month_of, ratio


def category_totals(ledger: DataFrame) -> DataFrame:
    """Sum of expenses by user and category."""
    return ledger.filter(is_expense()).groupBy("user_id", "category").agg(F.sum("amount").alias("total"))


def category_stats(ledger: DataFrame) -> DataFrame:
    """Sum, count and mean of expenses by user and category."""
    grouped = ledger.filter(is_expense()).groupBy("user_id", "category")
    out = grouped.agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
    return out.withColumn("mean", F.col("total").cast("double") / F.col("n"))


def monthly_totals(ledger: DataFrame) -> DataFrame:
    """Sum and count by user, type and calendar month. Months without rows are absent, not zero."""
    return ledger.groupBy("user_id", "txn_type", month_of().alias("month")).agg(
        F.sum("amount").alias("total"), F.count("*").alias("n")
    )


def month_series(ledger: DataFrame) -> DataFrame:
    """`monthly_totals` with x = 0, 1, 2, ... over the months present, by user and type.

    The small monthly rows are laid out by user once: the window and any later aggregate by user reuse it.
    """
    by_month = Window.partitionBy("user_id", "txn_type").orderBy("month")
    monthly = monthly_totals(ledger).repartition("user_id")
    return monthly.withColumn("x", F.row_number().over(by_month) - 1).withColumn("y", F.col("total").cast("double"))


def spending_summary(ledger: DataFrame) -> DataFrame:
    """Per user: spending by category and by month as maps, the total and the mean monthly total.

    Grouping sets read the ledger once for both maps. Rows that are no expenses count for the user alone, so they carry no
    category or month and collapse before the shuffle.
    """
    spending = [F.when(is_expense(), value).alias(name) for name, value in (("category", F.col("category")), ("month", month_of()), ("amount", F.col("amount")))]
    sums = ledger.select("user_id", *spending).groupingSets([["user_id", "category"], ["user_id", "month"]], "user_id", "category", "month").agg(
        F.sum("amount").alias("total"), F.grouping("category").alias("is_month")
    )
    spent = F.col("total").isNotNull()
    of_month = spent & (F.col("is_month") == 1)
    entry_of_month = F.struct(F.date_format("month", "yyyy-MM").alias("month"), "total")
    monthly = F.when(of_month, F.col("total"))
    return sums.groupBy("user_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(spent & (F.col("is_month") == 0), F.struct("category", "total"))))
        ).alias("category_spending"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(of_month, entry_of_month)))).alias("monthly_trends"),
        F.coalesce(F.sum(monthly), F.lit(0).cast(MONEY)).alias("total_expenses"),
        ratio(F.sum(monthly), F.count(monthly)).alias("average_monthly"),
    )


def top_categories(totals: DataFrame) -> DataFrame:
    """From category totals: each user's largest category (ties: first by name) and its share in percent, by one aggregate."""
    largest = F.min(F.struct((-F.col("total")).alias("minus"), F.col("category")))
    per_user = totals.groupBy("user_id").agg(largest.alias("top"), F.sum("total").alias("total_expenses"))
    top = -F.col("top.minus")
    share = top.cast("double") / F.col("total_expenses").cast("double") * 100.0
    return per_user.select(
        "user_id", F.col("top.category").alias("top_category"), top.alias("top_total"), "total_expenses", share.alias("top_percent")
    )


def concentration(ledger: DataFrame, threshold: float = 40.0) -> DataFrame:
    """Users whose largest category takes more than `threshold` percent of their spending."""
    return top_categories(category_totals(ledger)).filter(F.col("top_percent") > threshold)


def high_spending_days(ledger: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Days whose total lies strictly above the user's linearly interpolated quantile of daily totals.

    The array per user holds one value per calendar day with spending, however many rows the user has.
    """
    daily = (
        ledger.filter(is_expense())
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.sum("amount").cast("double").alias("total"))
    )
    per_user = daily.groupBy("user_id").agg(
        F.percentile("total", F.lit(quantile)).alias("threshold"),
        F.count("*").alias("n_days"),
        F.collect_list("total").alias("totals"),
    )
    return per_user.select(
        "user_id",
        "threshold",
        "n_days",
        F.size(F.filter("totals", lambda v: v > F.col("threshold"))).alias("n_high_days"),
    )


def spending_insights(ledger: DataFrame) -> DataFrame:
    """Concentration and high-spending-day insights, one row each, with the number that caused them."""
    top = concentration(ledger).select(
        "user_id",
        F.lit("concentration_risk").alias("insight_type"),
        F.col("top_category").alias("subject"),
        F.col("top_percent").alias("value"),
    )
    days = high_spending_days(ledger).filter("n_high_days > 0").select(
        "user_id",
        F.lit("high_spending_days").alias("insight_type"),
        F.lit(None).cast("string").alias("subject"),
        F.col("n_high_days").cast("double").alias("value"),
    )
    return top.unionByName(days)
