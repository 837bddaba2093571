"""Income: variability, stability, volatility, trend, projection, seasonality, sources.

All series are monthly sums over the months present; gaps between months are not filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.money import MONEY, is_income, mean_of, ratio
from tallyflow.functions.scoring import variability_label
from tallyflow.functions.trend import line_sums, slope, value_at
from tallyflow.operators.spending import month_series, monthly_totals


def income_months(ledger: DataFrame) -> DataFrame:
    return monthly_totals(ledger.filter(is_income())).withColumn("y", F.col("total").cast("double"))


def _of_all_users(ledger: DataFrame, *columns: Column) -> DataFrame:
    """Aggregates of monthly incomes for every user of the ledger, those without income too: their months are NULL."""
    monthly = monthly_totals(ledger)
    kept = [F.when(is_income(), F.col(c)).alias(c) for c in ("month", "total")]
    income = monthly.select("user_id", *kept).withColumn("y", F.col("total").cast("double"))
    return income.groupBy("user_id").agg(*columns)


def income_variability(ledger: DataFrame) -> DataFrame:
    """Sample coefficient of variation of monthly income with its label and the months as a map.

    A user without income has zeros, no months and no label, but a stability score of 1.
    """
    entry = F.struct(F.date_format("month", "yyyy-MM").alias("month"), "total")
    per_user = _of_all_users(
        ledger,
        F.count("total").alias("n_months"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("total").isNotNull(), entry)))).alias("monthly_income"),
        F.coalesce(mean_of("total"), F.lit(0.0)).alias("average_income"),
        F.coalesce(F.sum("total"), F.lit(0).cast(MONEY)).alias("total_income"),
        F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("sd"),
    )
    out = per_user.withColumn("variability", ratio(F.col("sd"), F.col("average_income")))
    some = F.col("n_months") > 0
    return out.withColumns({
        "income_stability": F.when(some, variability_label(F.col("variability"))),
        "stability_score": F.when(~some, F.lit(1.0)),
    }).drop("sd")


def _unless_short(value: Column) -> Column:
    """NULL below three months."""
    return F.when(F.col("n_months") >= 3, value)


def income_stability(ledger: DataFrame) -> DataFrame:
    """Stability score, volatility, trend direction and range; below three months a fixed neutral answer."""
    series = month_series(ledger.filter(is_income()))
    n, sy, sxy = line_sums(F.col("x"), F.col("total"))
    per_user = series.groupBy("user_id").agg(
        n.alias("n_months"),
        sy.alias("sy"),
        sxy.alias("sxy"),
        mean_of("total").alias("average"),
        F.min("y").alias("lowest"),
        F.max("y").alias("highest"),
        F.stddev_samp("y").alias("sd"),
    )
    per_user = per_user.withColumn("slope", slope(F.col("n_months"), F.col("sy"), F.col("sxy")))
    volatility = ratio(F.col("sd"), F.col("average"))
    trend = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable")
    return per_user.select(
        "user_id",
        "n_months",
        F.coalesce(_unless_short(F.greatest(F.lit(0.0), 1.0 - volatility)), F.lit(0.5)).alias("stability_score"),
        F.coalesce(_unless_short(volatility), F.lit(0.0)).alias("volatility"),
        F.coalesce(_unless_short(trend), F.lit("insufficient_data")).alias("trend"),
        _unless_short(F.col("average")).alias("average_income"),
        _unless_short(F.col("lowest")).alias("min_income"),
        _unless_short(F.col("highest")).alias("max_income"),
    )


def income_volatility(ledger: DataFrame) -> DataFrame:
    """Sample coefficient of variation; 0 below two months, without positive mean and without income."""
    cv = ratio(F.coalesce(F.stddev_samp("y"), F.lit(0.0)), F.coalesce(mean_of("total"), F.lit(0.0)))
    return _of_all_users(ledger, F.count("total").alias("n_months"), cv.alias("volatility"))


def income_volatility_population(ledger: DataFrame) -> DataFrame:
    """The agent's form: population coefficient of variation and stability 1 - CV, not below 0."""
    per_user = income_months(ledger).groupBy("user_id").agg(
        F.count("*").alias("n_months"), ratio(F.stddev_pop("y"), mean_of("total")).alias("volatility")
    )
    return per_user.withColumn("stability_score", F.greatest(F.lit(0.0), 1.0 - F.col("volatility")))


def trend_sums(ledger: DataFrame) -> DataFrame:
    """By user and type: number of months and the sums the line is made of."""
    n, sy, sxy = line_sums(F.col("x"), F.col("total"))
    return month_series(ledger).groupBy("user_id", "txn_type").agg(
        n.alias("n_months"), sy.alias("sy"), sxy.alias("sxy"), F.regr_r2("y", "x").alias("r2")
    )



def _sums() -> tuple[Column, Column, Column]:
    return F.col("n_months"), F.col("sy"), F.col("sxy")


def linear_trends(ledger: DataFrame) -> DataFrame:
    """Least-squares line of monthly sums by user and type: slope, intercept, r squared."""
    return trend_sums(ledger).select(
        "user_id", "txn_type", "n_months", slope(*_sums()).alias("slope"), value_at(F.lit(0), *_sums()).alias("intercept"), "r2"
    )


def _next_three() -> Column:
    """The line at x = n + 1, n + 2, n + 3. With x starting at 0 this skips one month; it is meant to."""
    return F.array(*[value_at(F.col("n_months") + step, *_sums()) for step in (1, 2, 3)])


def _enough(value: Column) -> Column:
    return F.when(F.col("n_months") >= 3, value)


def income_projection(ledger: DataFrame) -> DataFrame:
    """Next three months of income, with confidence by the number of months."""
    return trend_sums(ledger.filter(is_income())).select(
        "user_id",
        "n_months",
        F.when(F.col("n_months") >= 3, "available").otherwise("insufficient_data").alias("projection"),
        _enough(_next_three()).alias("next_3_months"),
        _enough(slope(*_sums())).alias("trend_slope"),
        _enough(F.when(F.col("n_months") >= 6, "medium").otherwise("low")).alias("confidence"),
    )


def series_predictions(ledger: DataFrame) -> DataFrame:
    """Income and expense predictions. The trend has two values only: a flat line counts as decreasing.

    A constant series has r squared 1: the line explains all of a variation of zero.
    """
    fit = F.coalesce(F.col("r2"), F.lit(1.0))
    return trend_sums(ledger).select(
        "user_id",
        "txn_type",
        "n_months",
        F.when(F.col("n_months") < 3, "Insufficient data for prediction").alias("error"),
        _enough(_next_three()).alias("predictions"),
        _enough(F.when(slope(*_sums()) > 0, "increasing").otherwise("decreasing")).alias("trend"),
        _enough(fit).alias("r_squared"),
    )


def seasonality(ledger: DataFrame) -> DataFrame:
    """Mean income per transaction by month of year; seasonal when its sample CV exceeds 0.3.

    Peak and low months are given only then, three each, ties by the earlier month.
    """
    monthly = (
        ledger.filter(is_income())
        .groupBy("user_id", F.month("ts").alias("month"))
        .agg(mean_of("amount").alias("mean"))
    )
    per_user = monthly.groupBy("user_id").agg(
        F.count("*").alias("n_months"),
        ratio(F.stddev_samp("mean"), F.avg("mean")).alias("variation"),
        F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("key"), "month"))).alias("high_first"),
        F.array_sort(F.collect_list(F.struct(F.col("mean").alias("key"), "month"))).alias("low_first"),
    )
    seasonal = (F.col("n_months") >= 3) & (F.col("variation") > 0.3)
    return per_user.select(
        "user_id",
        "n_months",
        seasonal.alias("seasonality_detected"),
        F.when(seasonal, F.col("variation")).alias("variation_coefficient"),
        F.when(seasonal, F.slice("high_first.month", 1, 3)).alias("peak_months"),
        F.when(seasonal, F.slice("low_first.month", 1, 3)).alias("low_months"),
    )


def income_sources(ledger: DataFrame) -> DataFrame:
    """Sum of income by user and category."""
    return ledger.filter(is_income()).groupBy("user_id", "category").agg(F.sum("amount").alias("total"))
