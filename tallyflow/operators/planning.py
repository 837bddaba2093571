"""Budget, investment and debt plans, and the context handed to a recommender."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions import fixed_values as fv
from tallyflow.functions.literals import literal_rows
from tallyflow.functions.money import MONEY, is_expense, is_income, mean_of, ratio
from tallyflow.operators.income import income_months
from tallyflow.operators.skew import rank_within


def average_monthly_income(ledger: DataFrame) -> DataFrame:
    """Mean monthly income by user, for plans that are given no declared income."""
    return income_months(ledger).groupBy("user_id").agg(
        mean_of("total").alias("monthly_income")
    )


def spending_by_category(ledger: DataFrame) -> DataFrame:
    """Absolute expenses by category; a missing category is 'uncategorized', a missing amount 0."""
    amount = F.abs(F.coalesce(F.col("amount"), F.lit(0).cast(MONEY)))
    category = F.coalesce(F.col("category"), F.lit(fv.MISSING_CATEGORY)).alias("category")
    return ledger.filter(is_expense()).groupBy("user_id", category).agg(F.sum(amount).alias("total"))


def category_budgets(ledger: DataFrame, incomes: DataFrame) -> DataFrame:
    """Per category: 15 percent less where the total exceeds a tenth of the monthly income, else as it is.

    Totals cover all rows given, not one month.
    """
    income = F.coalesce(F.col("monthly_income"), F.lit(0.0))
    total = F.col("total").cast("double")
    budget = F.when(total > income * 0.1, total * 0.85).otherwise(total)
    joined = spending_by_category(ledger).join(incomes, "user_id", "left")
    return joined.select("user_id", "category", "total", budget.alias("budget"))


def budget_plan(ledger: DataFrame, incomes: DataFrame) -> DataFrame:
    """50/30/20 split of the monthly income (NULL without income) next to the total of all expenses."""
    spent = spending_by_category(ledger).groupBy("user_id").agg(F.sum("total").alias("total_expenses"))
    joined = incomes.join(spent, "user_id", "full_outer")
    income = F.when(F.col("monthly_income") > 0, F.col("monthly_income"))
    return joined.select(
        "user_id",
        (income * 0.5).alias("needs"),
        (income * 0.3).alias("wants"),
        (income * 0.2).alias("savings"),
        F.coalesce(F.col("total_expenses"), F.lit(0).cast(MONEY)).alias("total_expenses"),
    )


def strategies(spark: SparkSession) -> DataFrame:
    """Fixed table of three rows."""
    names = ("strategy", "bonds", "stocks", "cash", "expected_return", "funds")
    return literal_rows(spark, names, fv.INVESTMENT_STRATEGIES)


def investment_plan(profiles: DataFrame, incomes: DataFrame) -> DataFrame:
    """Strategy by risk tolerance (moderate for an unknown one) and a fifth of the monthly income."""
    known = [s[0] for s in fv.INVESTMENT_STRATEGIES]
    tolerance = F.col("risk_tolerance")
    chosen = F.when(tolerance.isin(*known), tolerance).otherwise(fv.DEFAULT_RISK_TOLERANCE)
    table = F.broadcast(strategies(profiles.sparkSession))
    joined = profiles.join(incomes, "user_id", "left").withColumn("strategy", chosen).join(table, "strategy")
    monthly = F.coalesce(F.col("monthly_income"), F.lit(0.0)) * 0.2
    return joined.select(
        "user_id", "strategy", "bonds", "stocks", "cash", "expected_return", "funds", monthly.alias("monthly_investment")
    )


def debt_totals(debts: DataFrame, incomes: DataFrame) -> DataFrame:
    """Total debt, total monthly payment and the payments' share of the monthly income (0 without income)."""
    totals = debts.groupBy("user_id").agg(
        F.sum("amount").alias("total_debt"), F.sum("monthly_payment").alias("total_monthly_payment")
    )
    joined = totals.join(incomes, "user_id", "left")
    return joined.select(
        "user_id",
        "total_debt",
        "total_monthly_payment",
        ratio(F.col("total_monthly_payment"), F.coalesce(F.col("monthly_income"), F.lit(0.0))).alias("debt_to_income"),
    )


def debt_ranking(debts: DataFrame, method: str = "avalanche", rate_step: float = 0.01, amount_step: float = 1000.0) -> DataFrame:
    """Payoff order: highest interest first, or (snowball) smallest amount first; ties by debt id.

    A user's debts are numbered by steps of the rate or amount, so a user of any size is spread over tasks.
    """
    value, step, falling = ("interest_rate", rate_step, True) if method == "avalanche" else ("amount", amount_step, False)
    columns = ["user_id", "debt_id", "amount", "monthly_payment", "interest_rate"]
    cell = F.floor(F.col(value).cast("double") / F.lit(step))
    # NULL sorts last when falling and first when rising
    chunk = F.coalesce(-cell, F.lit(2**62)) if falling else F.coalesce(cell, F.lit(-(2**62)))
    order = [F.col(value).desc() if falling else F.col(value).asc(), F.col("debt_id").asc()]
    return rank_within(debts.select(*columns), "user_id", chunk, order, "payoff_order")


def recommendation_context(ledger: DataFrame, profiles: DataFrame) -> DataFrame:
    """Totals, row count, sorted distinct categories and employment, with the same as a JSON text.

    Categories are made distinct by (user, category) before they are gathered.
    """
    cells = ledger.groupBy("user_id", "category").agg(
        F.sum(F.when(is_income(), F.col("amount"))).alias("income"),
        F.sum(F.when(is_expense(), F.col("amount"))).alias("expenses"),
        F.count("*").alias("n"),
    )
    zero = F.lit(0).cast(MONEY)
    per_user = cells.groupBy("user_id").agg(
        F.coalesce(F.sum("income"), zero).alias("total_income"),
        F.coalesce(F.sum("expenses"), zero).alias("total_expenses"),
        F.sum("n").alias("transaction_count"),
        F.array_sort(F.collect_list("category")).alias("categories"),
    )
    joined = per_user.join(profiles.select("user_id", "employment_type"), "user_id", "left").withColumn(
        "employment_type", F.coalesce("employment_type", F.lit("unknown"))
    )
    summary = F.struct("total_income", "total_expenses", "transaction_count", "categories")
    context = F.struct(summary.alias("financial_summary"), F.struct("employment_type").alias("user_profile"))
    return joined.withColumn("context", F.to_json(context))
