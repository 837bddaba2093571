"""Income queries."""

from pyspark.sql import functions as F

from tallyflow.catalog.registry import MONTHS, STAR, STRETCHED, big, dbl, money, num, query, r, rat, with_
from tallyflow.operators import income
from tallyflow.sources.star import events_as_ledger, star_ledger, stretched, table


def _ledger(spark, sf_dir):
    return star_ledger(spark, sf_dir, with_category=False)


INCOME = """per_user AS (
  SELECT user_id, COUNT(*) AS n, CAST(SUM(total) AS DOUBLE) / COUNT(*) AS mean, SUM(total) AS total, MIN(y) AS lo, MAX(y) AS hi, stddev_samp(y) AS sd,
         stddev_pop(y) AS sd_pop, regr_slope(y, x) AS slope
  FROM series WHERE txn_type = 'income' GROUP BY 1)"""
CV = rat("COALESCE(sd, 0)", "mean")


@query(with_(STAR, MONTHS, INCOME, select=f"""
SELECT user_id, n AS n_months, {r('mean', 4)} AS average_income, {dbl('total')} AS total_income, {r(CV)} AS variability,
       CASE WHEN {CV} < 0.2 THEN 'stable' WHEN {CV} < 0.5 THEN 'moderate' ELSE 'highly_variable' END AS income_stability
FROM per_user"""))
def income_variability(spark, sf_dir):
    out = income.income_variability(_ledger(spark, sf_dir))
    return out.select(
        "user_id", big("n_months"), num("average_income", 4), money("total_income"), num("variability"), "income_stability"
    )


@query(with_(STAR, MONTHS, INCOME, select=f"""
SELECT user_id, n AS n_months,
       CASE WHEN n < 3 THEN 0.5 ELSE {r(f'greatest(0, 1 - {CV})')} END AS stability_score,
       CASE WHEN n < 3 THEN 0.0 ELSE {r(CV)} END AS volatility,
       CASE WHEN n < 3 THEN 'insufficient_data' WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS trend,
       CASE WHEN n >= 3 THEN {r('mean', 4)} END AS average_income, CASE WHEN n >= 3 THEN lo END AS min_income,
       CASE WHEN n >= 3 THEN hi END AS max_income
FROM per_user"""))
def income_stability(spark, sf_dir):
    out = income.income_stability(_ledger(spark, sf_dir))
    return out.select(
        "user_id", big("n_months"), num("stability_score"), num("volatility"), "trend", num("average_income", 4),
        "min_income", "max_income",
    )


@query(with_(STAR, MONTHS, INCOME, select=f"SELECT user_id, n AS n_months, {r(CV)} AS volatility FROM per_user"))
def income_volatility(spark, sf_dir):
    return income.income_volatility(_ledger(spark, sf_dir)).select("user_id", big("n_months"), num("volatility"))


EVERY = """months AS (
  SELECT user_id, strftime(ts, '%Y-%m') AS month, SUM(amount) FILTER (txn_type = 'income') AS total FROM ledger GROUP BY 1, 2),
everyone AS (
  SELECT user_id, COUNT(total) AS n, COALESCE(CAST(SUM(total) AS DOUBLE) / nullif(COUNT(total), 0), 0) AS mean, COALESCE(SUM(total), 0) AS total,
         stddev_samp(CAST(total AS DOUBLE)) AS sd, string_agg(month || '=' || CAST(total AS VARCHAR), ' ' ORDER BY month) FILTER (total IS NOT NULL) AS months
  FROM months GROUP BY 1)"""
# A ledger in which many users have no income: signups are the only one, and only those above 50.
FEW = STRETCHED.replace("CASE WHEN event_type IN ('signup', 'purchase') THEN", "CASE WHEN event_type = 'signup' AND value > 50 THEN")


def _few_incomes(spark, sf_dir):
    rows = events_as_ledger(stretched(table(spark, sf_dir, "events")))
    earned = (F.col("category") == "signup") & (F.col("amount") > 50)
    return rows.withColumn("txn_type", F.when(earned, "income").otherwise("expense"))


@query(with_(FEW, EVERY, select=f"""
SELECT user_id, n AS n_months, {r('mean', 4)} AS average_income, {dbl('total')} AS total_income, {r(CV)} AS variability,
       CASE WHEN n = 0 THEN NULL WHEN {CV} < 0.2 THEN 'stable' WHEN {CV} < 0.5 THEN 'moderate' ELSE 'highly_variable' END AS income_stability,
       CASE WHEN n = 0 THEN 1.0::DOUBLE END AS stability_score, COALESCE(months, '') AS monthly_income
FROM everyone"""))
def income_variability_all_users(spark, sf_dir):
    """With the users that have no income, and the map of months as text."""
    out = income.income_variability(_few_incomes(spark, sf_dir))
    entries = F.transform(F.map_entries("monthly_income"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select(
        "user_id", big("n_months"), num("average_income", 4), money("total_income"), num("variability"), "income_stability",
        "stability_score", F.array_join(F.array_sort(entries), " ").alias("monthly_income"),
    )


@query(with_(FEW, EVERY, select=f"SELECT user_id, n AS n_months, {r(CV)} AS volatility FROM everyone"))
def income_volatility_all_users(spark, sf_dir):
    return income.income_volatility(_few_incomes(spark, sf_dir)).select("user_id", big("n_months"), num("volatility"))


POP = rat("sd_pop", "mean")


@query(with_(STAR, MONTHS, INCOME, select=f"""
SELECT user_id, n AS n_months, {r(POP)} AS volatility, {r(f'greatest(0, 1 - {POP})')} AS stability_score FROM per_user"""))
def income_volatility_pop(spark, sf_dir):
    out = income.income_volatility_population(_ledger(spark, sf_dir))
    return out.select("user_id", big("n_months"), num("volatility"), num("stability_score"))


# Exact sums in cents: monthly values are rational, so a line can fall exactly between two cents.
LINES = """sums AS (
  SELECT user_id, txn_type, COUNT(*)::HUGEINT AS n, SUM((total * 100)::HUGEINT)::HUGEINT AS sy,
         SUM((total * 100)::HUGEINT * x::HUGEINT)::HUGEINT AS sxy, SUM(x::HUGEINT)::HUGEINT AS sx,
         SUM(x::HUGEINT * x::HUGEINT)::HUGEINT AS sxx, regr_r2(y, x) AS r2
  FROM series GROUP BY ALL),
lines AS (
  SELECT user_id, txn_type, n::BIGINT AS n, r2, (n * sxy - sx * sy)::HUGEINT AS rise, (sy * sxx - sx * sxy)::HUGEINT AS base,
         nullif(n * sxx - sx * sx, 0)::DOUBLE * 100.0 AS det
  FROM sums)"""
SLOPE, INTERCEPT = "(rise::DOUBLE / det)", "(base::DOUBLE / det)"


def at(step: int) -> str:
    return f"((base + (n + {step})::HUGEINT * rise)::DOUBLE / det)"


@query(with_(STAR, MONTHS, LINES, select=f"""
SELECT user_id, txn_type, n AS n_months, {r(SLOPE, 2)} AS slope, {r(INTERCEPT, 2)} AS intercept, {r('r2')} AS r2 FROM lines"""))
def linear_trend(spark, sf_dir):
    out = income.linear_trends(_ledger(spark, sf_dir))
    return out.select("user_id", "txn_type", big("n_months"), num("slope", 2), num("intercept", 2), num("r2"))


def _steps(name):
    return [F.floor(F.col(name)[i] * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0) for i in range(3)]


@query(with_(STAR, MONTHS, LINES, select=f"""
SELECT user_id, n AS n_months, CASE WHEN n >= 3 THEN 'available' ELSE 'insufficient_data' END AS projection,
       CASE WHEN n >= 3 THEN {r(at(1), 2)} END AS next_1, CASE WHEN n >= 3 THEN {r(at(2), 2)} END AS next_2,
       CASE WHEN n >= 3 THEN {r(at(3), 2)} END AS next_3, CASE WHEN n >= 3 THEN {r(SLOPE, 2)} END AS trend_slope,
       CASE WHEN n >= 6 THEN 'medium' WHEN n >= 3 THEN 'low' END AS confidence
FROM lines WHERE txn_type = 'income'"""))
def income_projection(spark, sf_dir):
    out = income.income_projection(_ledger(spark, sf_dir))
    ahead = [c.alias(f"next_{i}") for i, c in enumerate(_steps("next_3_months"), 1)]
    return out.select("user_id", big("n_months"), "projection", *ahead, num("trend_slope", 2), "confidence")


@query(with_(STAR, MONTHS, LINES, select=f"""
SELECT user_id, txn_type, n AS n_months, CASE WHEN n < 3 THEN 'Insufficient data for prediction' END AS error,
       CASE WHEN n >= 3 THEN {r(at(1), 2)} END AS next_1, CASE WHEN n >= 3 THEN {r(at(2), 2)} END AS next_2,
       CASE WHEN n >= 3 THEN {r(at(3), 2)} END AS next_3,
       CASE WHEN n >= 3 THEN CASE WHEN rise > 0 THEN 'increasing' ELSE 'decreasing' END END AS trend,
       CASE WHEN n >= 3 THEN {r('COALESCE(r2, 1.0)')} END AS r_squared
FROM lines"""))
def series_prediction(spark, sf_dir):
    out = income.series_predictions(_ledger(spark, sf_dir))
    ahead = [c.alias(f"next_{i}") for i, c in enumerate(_steps("predictions"), 1)]
    return out.select("user_id", "txn_type", big("n_months"), "error", *ahead, "trend", num("r_squared"))


@query(with_(STAR, f"""by_month AS (
  SELECT user_id, month(ts) AS m, {dbl('SUM(amount)')} / COUNT(*) AS v FROM ledger WHERE txn_type = 'income' GROUP BY ALL),
cv AS (SELECT user_id, COUNT(*) AS n, stddev_samp(v) / AVG(v) AS cv FROM by_month GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, m) AS hi,
           row_number() OVER (PARTITION BY user_id ORDER BY v, m) AS lo FROM by_month),
ends AS (SELECT user_id, string_agg(CAST(m AS VARCHAR), ',' ORDER BY hi) FILTER (hi <= 3) AS peak_months,
         string_agg(CAST(m AS VARCHAR), ',' ORDER BY lo) FILTER (lo <= 3) AS low_months FROM ranked GROUP BY 1)""",
    select=f"""
SELECT user_id, n AS n_months, n >= 3 AND cv > 0.3 AS seasonality_detected,
       CASE WHEN n >= 3 AND cv > 0.3 THEN {r('cv')} END AS variation_coefficient,
       CASE WHEN n >= 3 AND cv > 0.3 THEN peak_months END AS peak_months, CASE WHEN n >= 3 AND cv > 0.3 THEN low_months END AS low_months
FROM cv JOIN ends USING (user_id)"""))
def seasonality(spark, sf_dir):
    out = income.seasonality(_ledger(spark, sf_dir))
    return out.select(
        "user_id", big("n_months"), F.coalesce("seasonality_detected", F.lit(False)).alias("seasonality_detected"),
        num("variation_coefficient"),
        F.concat_ws(",", F.col("peak_months").cast("array<string>")).alias("peak_months"),
        F.concat_ws(",", F.col("low_months").cast("array<string>")).alias("low_months"),
    ).withColumns({
        "peak_months": F.nullif("peak_months", F.lit("")), "low_months": F.nullif("low_months", F.lit("")),
    })


@query(with_(STAR, select=f"""
SELECT user_id, category, {dbl('SUM(amount)')} AS total FROM ledger WHERE txn_type = 'income' GROUP BY ALL"""))
def income_sources(spark, sf_dir):
    return income.income_sources(star_ledger(spark, sf_dir)).select("user_id", "category", money("total"))
