"""Health scores, risk rules and recommendations as column expressions over per-user metrics.

The thresholds are inclusive or strict exactly as written. Three scores exist on purpose; they disagree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyflow.functions import fixed_values as fv
from tallyflow.functions.money import present, steps


def irregular(employment: Column) -> Column:
    """True for gig and informal work; an unknown employment is not irregular."""
    return F.coalesce(employment.isin(*fv.IRREGULAR_EMPLOYMENT), F.lit(False))


def _clamped(points: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("int")


def health_score(savings: Column, expense_ratio: Column, volatility: Column, employment: Column) -> Column:
    """Base 50, up to 25 for savings, 15 for the expense ratio, 10 for steady income, 10 off if irregular.

    No income gives ratios of 0 and volatility 0, hence 75 and not a low score.
    """
    return _clamped(
        F.lit(50)
        + steps(savings, [(savings >= 0.2, 25), (savings >= 0.1, 15), (savings >= 0.05, 5)])
        + steps(expense_ratio, [(expense_ratio <= 0.7, 15), (expense_ratio <= 0.85, 10), (expense_ratio <= 0.95, 5)])
        + steps(volatility, [(volatility <= 0.1, 10), (volatility <= 0.2, 7), (volatility <= 0.3, 3)])
        - F.when(irregular(employment), 10).otherwise(0)
    )


def agent_health_score(savings: Column, volatility: Column, employment: Column) -> Column:
    """The agent's score: no expense ratio, heavier weights, population volatility."""
    return _clamped(
        F.lit(50)
        + steps(savings, [(savings >= 0.2, 30), (savings >= 0.1, 20), (savings >= 0.05, 10)])
        + steps(volatility, [(volatility <= 0.1, 15), (volatility <= 0.2, 10), (volatility <= 0.3, 5)])
        - F.when(irregular(employment), 10).otherwise(0)
    )


def dashboard_score(savings_percent: Column) -> Column:
    """The dashboard's score from the savings percentage, rounded half up.

    Not monotonic: 4.9 percent gives 99 and 5 percent gives 50.
    """
    s = savings_percent
    raw = (
        F.when(s >= 20, 85.0 + F.least(F.lit(15.0), s - 20.0))
        .when(s >= 10, 70.0 + (s - 10.0))
        .when(s >= 5, 50.0 + (s - 5.0) * 4.0)
        .otherwise(F.greatest(F.lit(0.0), 50.0 + s * 10.0))
    )
    return F.floor(raw + 0.5).cast("int")


def _risk(kind: str, severity: Column | str) -> Column:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(F.lit(kind).alias("risk"), severity.alias("severity"))


def risk_factors(savings: Column, expense_ratio: Column, volatility: Column) -> Column:
    return present(
        F.when(savings < 0.05, _risk("low_savings", "high")),
        F.when(expense_ratio > 0.95, _risk("high_expenses", "high")),
        F.when(volatility > 0.4, _risk("high_volatility", "medium")),
    )


def assessed_risks(
    income: Column, expenses: Column, income_rows: Column, expense_rows: Column, volatility: Column, employment: Column
) -> Column:
    """Risks in order: unsteady income, spending above 90 percent of income, irregular employment."""
    overspent = (income_rows > 0) & (expense_rows > 0) & (expenses > income * F.lit(0.9))
    return present(
        F.when(
            (income_rows > 0) & (volatility > 0.3),
            _risk("income_volatility", F.when(volatility > 0.5, "high").otherwise("medium")),
        ),
        F.when(overspent, _risk("overspending", "high")),
        F.when(irregular(employment), _risk("emergency_fund", "high")),
    )


def overall_risk(risks: Column) -> Column:
    high = F.size(F.filter(risks, lambda r: r["severity"] == "high"))
    medium = F.size(F.filter(risks, lambda r: r["severity"] == "medium"))
    return (
        F.when(high >= 2, "very_high")
        .when(high == 1, "high")
        .when(medium >= 2, "medium")
        .when(medium == 1, "low-medium")
        .otherwise("low")
    )


def _recommendation(values: tuple[str, ...]) -> Column:
    names = ("category", "priority", "action", "impact", "timeline")
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])


def recommendations(savings: Column, employment: Column) -> Column:
    return present(
        F.when(savings < 0.1, _recommendation(fv.SAVINGS_RECOMMENDATION)),
        F.when(irregular(employment), _recommendation(fv.EMERGENCY_RECOMMENDATION)),
    )


def variability_label(cv: Column) -> Column:
    return F.when(cv < 0.2, "stable").when(cv < 0.5, "moderate").otherwise("highly_variable")
