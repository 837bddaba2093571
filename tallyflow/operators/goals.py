"""Progress on the four goals, from one aggregate per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import fixed_values as fv
from tallyflow.functions.categorize import category_in
from tallyflow.functions.money import is_expense, is_income, ratio, sum_where

TARGET_MONTHS = 6


def goal_sums(ledger: DataFrame) -> DataFrame:
    """Per user sums and counts behind all four goals.

    Expense months are months of the year, so January of two years counts once; they are kept as a bit mask,
    which aggregates on both sides of the shuffle. Debt and investment go by category alone, whatever the type.
    """
    debt = category_in(F.col("category"), fv.DEBT_CATEGORIES)
    invested = category_in(F.col("category"), fv.INVESTMENT_CATEGORIES)
    amount = F.col("amount")
    month_bit = F.expr("shiftleft(1, month(ts) - 1)")
    return ledger.groupBy("user_id").agg(
        sum_where(is_income(), amount).alias("total_income"),
        sum_where(is_expense(), amount).alias("total_expenses"),
        F.count_if(is_expense()).alias("n_expense"),
        F.bit_count(F.coalesce(F.bit_or(F.when(is_expense(), month_bit)), F.lit(0))).alias("months_of_year"),
        sum_where(debt, amount).alias("debt_total"),
        F.count_if(debt).alias("n_debt"),
        sum_where(invested, amount).alias("invested_total"),
        F.count_if(invested).alias("n_invested"),
    )


def _emergency_columns() -> list[Column]:
    saved_exact = F.col("total_income") - F.col("total_expenses")
    saved = saved_exact.cast("double")
    monthly = F.col("total_expenses").cast("double") / F.greatest(F.lit(1), F.col("months_of_year"))
    target = monthly * TARGET_MONTHS
    progress = F.when(target > 0, saved / target * 100.0).otherwise(0.0)
    months = F.when(monthly > 0, (saved / monthly).cast("bigint")).otherwise(0)
    has = F.col("n_expense") > 0
    return [
        F.when(~has, "no_data").when(progress >= 100, "on_track").otherwise("in_progress").alias("status"),
        F.when(has, saved_exact).alias("current_savings"),
        F.when(has, target).alias("target_amount"),
        F.when(has, progress).alias("progress_percentage"),
        F.when(has, months).alias("months_covered"),
    ]


def _savings_columns() -> list[Column]:
    saved = F.col("total_income") - F.col("total_expenses")
    return [ratio(saved, F.col("total_income")).alias("savings_rate"), saved.alias("total_saved")]


def _payment_columns(total: str, n: str, none: str, total_name: str, n_name: str) -> list[Column]:
    found = F.col(n) > 0
    return [
        F.when(found, "detected").otherwise(none).alias("status"),
        F.when(found, F.col(total)).alias(total_name),
        F.when(found, F.col(n)).alias(n_name),
    ]


def _debt_columns() -> list[Column]:
    return _payment_columns("debt_total", "n_debt", "no_debt_detected", "total_debt_payments", "payment_frequency")


def _investment_columns() -> list[Column]:
    return _payment_columns(
        "invested_total", "n_invested", "no_investments_detected", "total_invested", "investment_frequency"
    )


def emergency_fund(ledger: DataFrame) -> DataFrame:
    """Six months of average expenses against what was saved; months covered are cut toward zero.

    Users without expenses have status no_data and nothing else.
    """
    return goal_sums(ledger).select("user_id", *_emergency_columns())


def savings_goal(ledger: DataFrame) -> DataFrame:
    return goal_sums(ledger).select("user_id", *_savings_columns())


def debt_goal(ledger: DataFrame) -> DataFrame:
    """Payments in debt categories, or no_debt_detected."""
    return goal_sums(ledger).select("user_id", *_debt_columns())


def investment_goal(ledger: DataFrame) -> DataFrame:
    """Rows in investment categories, income included, or no_investments_detected."""
    return goal_sums(ledger).select("user_id", *_investment_columns())


def goal_bundle(ledger: DataFrame) -> DataFrame:
    """The four goals as struct columns, all projected from the same single aggregate."""
    return goal_sums(ledger).select(
        "user_id",
        F.struct(*_emergency_columns()).alias("emergency_fund"),
        F.struct(*_savings_columns()).alias("savings_goals"),
        F.struct(*_debt_columns()).alias("debt_reduction"),
        F.struct(*_investment_columns()).alias("investment_goals"),
    )
