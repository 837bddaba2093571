"""Cash flow, health scores, risks and recommendations, one row per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions import fixed_values as fv
from tallyflow.functions import scoring
from tallyflow.functions.literals import literal_rows
from tallyflow.functions.money import is_expense, is_income, mean_of, ratio, sum_where
from tallyflow.operators.spending import monthly_totals


def user_metrics(ledger: DataFrame) -> DataFrame:
    """Totals, rates and income volatility from one monthly aggregate of the ledger.

    Rates are 0 without income; volatility is 0 below two income months. Both volatilities are given: sample
    (`volatility`) and population (`volatility_pop`).
    """
    income = F.when(is_income(), F.col("total"))
    income_y = income.cast("double")
    amount, rows = F.col("total"), F.col("n")
    per_user = monthly_totals(ledger).groupBy("user_id").agg(
        sum_where(is_income(), amount).alias("total_income"),
        sum_where(is_expense(), amount).alias("total_expenses"),
        F.coalesce(F.sum(F.when(is_income(), rows)), F.lit(0)).alias("n_income"),
        F.coalesce(F.sum(F.when(is_expense(), rows)), F.lit(0)).alias("n_expense"),
        F.count(income_y).alias("income_months"),
        ratio(F.coalesce(F.stddev_samp(income_y), F.lit(0.0)), mean_of(income)).alias("volatility"),
        ratio(F.coalesce(F.stddev_pop(income_y), F.lit(0.0)), mean_of(income)).alias("volatility_pop"),
    )
    return with_rates(per_user)


def with_rates(totals: DataFrame) -> DataFrame:
    income, expenses = F.col("total_income"), F.col("total_expenses")
    return totals.withColumn("savings_rate", ratio(income - expenses, income)).withColumn(
        "expense_ratio", ratio(expenses, income)
    )


def cash_flow(ledger: DataFrame) -> DataFrame:
    """Income, expenses, savings rate and expense ratio by user."""
    amount = F.col("amount")
    totals = ledger.groupBy("user_id").agg(
        sum_where(is_income(), amount).alias("total_income"),
        sum_where(is_expense(), amount).alias("total_expenses"),
    )
    return with_rates(totals)


def with_profile(metrics: DataFrame, profiles: DataFrame) -> DataFrame:
    """Outer join to the profile: a user may have none, or one without employment type."""
    return metrics.join(profiles.select("user_id", "employment_type", "risk_tolerance"), "user_id", "left")


def health_scores(ledger: DataFrame, profiles: DataFrame) -> DataFrame:
    """The application's, the agent's and the dashboard's score side by side."""
    m = with_profile(user_metrics(ledger), profiles)
    savings, employment = F.col("savings_rate"), F.col("employment_type")
    return m.select(
        "user_id",
        "savings_rate",
        "expense_ratio",
        F.col("volatility").alias("income_volatility"),
        scoring.health_score(savings, F.col("expense_ratio"), F.col("volatility"), employment).alias("health_score"),
        scoring.agent_health_score(savings, F.col("volatility_pop"), employment).alias("agent_score"),
        scoring.dashboard_score(savings * 100.0).alias("dashboard_score"),
    )


def risk_factors(ledger: DataFrame) -> DataFrame:
    """One row per risk factor of the health report."""
    factors = scoring.risk_factors(F.col("savings_rate"), F.col("expense_ratio"), F.col("volatility"))
    return user_metrics(ledger).select("user_id", F.inline(factors))


def assessed(ledger: DataFrame, profiles: DataFrame) -> DataFrame:
    """Users with the array of their assessed risks and the overall level."""
    m = with_profile(user_metrics(ledger), profiles)
    risks = scoring.assessed_risks(
        F.col("total_income").cast("double"),
        F.col("total_expenses").cast("double"),
        F.col("n_income"),
        F.col("n_expense"),
        F.col("volatility"),
        F.col("employment_type"),
    )
    return m.select("user_id", risks.alias("risks")).withColumn("overall_risk", scoring.overall_risk(F.col("risks")))


def risk_assessment(ledger: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per assessed risk."""
    return assessed(ledger, profiles).select("user_id", F.inline("risks"))


def overall_risk(ledger: DataFrame, profiles: DataFrame) -> DataFrame:
    return assessed(ledger, profiles).select("user_id", F.size("risks").alias("n_risks"), "overall_risk")


def mitigations(spark: SparkSession) -> DataFrame:
    """Fixed table of three rows."""
    return literal_rows(spark, ("risk", "strategy", "timeline", "priority"), fv.MITIGATIONS)


def mitigation_plan(ledger: DataFrame, profiles: DataFrame) -> DataFrame:
    """Strategy, timeline and priority for every assessed risk; the lookup has three rows and is broadcast."""
    table = mitigations(ledger.sparkSession)
    return risk_assessment(ledger, profiles).join(F.broadcast(table), "risk").select(
        "user_id", "risk", "strategy", "timeline", "priority"
    )


def recommendations(ledger: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rule-based recommendations, one row each."""
    m = with_profile(cash_flow(ledger), profiles)
    return m.select("user_id", F.inline(scoring.recommendations(F.col("savings_rate"), F.col("employment_type"))))


