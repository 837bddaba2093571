"""Budget, investment, debt and context queries, and the comprehensive report."""

from pyspark.sql import functions as F

from tallyflow.catalog.health import OVERALL, RISKS, SCORE
from tallyflow.catalog.registry import HOUSEHOLD, METRICS, PROFILES, STAR, big, dbl, money, num, query, r, rat, with_
from tallyflow.functions import fixed_values as fv
from tallyflow.functions.money import round_to
from tallyflow.operators import planning
from tallyflow.plans.refresh import refresh_reports, stored_reports
from tallyflow.plans.report import comprehensive_report, reports_for
from tallyflow.session import shared_path
from tallyflow.sources.star import debts, household_ledger, profiles, star_ledger, table

INCOMES = """incomes AS (
  SELECT user_id, CAST(SUM(amount) AS DOUBLE) / COUNT(DISTINCT date_trunc('month', ts)) AS monthly_income
  FROM ledger WHERE txn_type = 'income' GROUP BY 1)"""
TOTALS = "cats AS (SELECT user_id, category, SUM(amount) AS total FROM ledger WHERE txn_type = 'expense' GROUP BY ALL)"


def _incomes(spark, sf_dir):
    return planning.average_monthly_income(star_ledger(spark, sf_dir, with_category=False))


@query(with_(STAR, INCOMES, TOTALS, select=f"""
SELECT COALESCE(i.user_id, s.user_id) AS user_id,
       CASE WHEN monthly_income > 0 THEN {r('monthly_income * 0.5::DOUBLE', 4)} END AS needs,
       CASE WHEN monthly_income > 0 THEN {r('monthly_income * 0.3::DOUBLE', 4)} END AS wants,
       CASE WHEN monthly_income > 0 THEN {r('monthly_income * 0.2::DOUBLE', 4)} END AS savings,
       COALESCE({dbl('spent')}, 0.0) AS total_expenses
FROM incomes i FULL JOIN (SELECT user_id, SUM(total) AS spent FROM cats GROUP BY 1) s ON i.user_id = s.user_id"""))
def budget_plan(spark, sf_dir):
    out = planning.budget_plan(star_ledger(spark, sf_dir), _incomes(spark, sf_dir))
    return out.select("user_id", num("needs", 4), num("wants", 4), num("savings", 4), money("total_expenses"))


@query(with_(STAR, INCOMES, TOTALS, select=f"""
SELECT user_id, category, {dbl('total')} AS total,
       {r("CASE WHEN total::DOUBLE > COALESCE(monthly_income, 0) * 0.1::DOUBLE THEN total::DOUBLE * 0.85::DOUBLE ELSE total::DOUBLE END", 4)} AS budget
FROM cats LEFT JOIN incomes USING (user_id)"""))
def category_budgets(spark, sf_dir):
    out = planning.category_budgets(star_ledger(spark, sf_dir), _incomes(spark, sf_dir))
    return out.select("user_id", "category", money("total"), num("budget", 4))


_STRATEGIES = ", ".join(str(s) for s in fv.INVESTMENT_STRATEGIES)


@query(with_(STAR, PROFILES, INCOMES, select=f"""
SELECT user_id, strategy, bonds::BIGINT AS bonds, stocks::BIGINT AS stocks, cash::BIGINT AS cash, expected_return, funds,
       {r('COALESCE(monthly_income, 0) * 0.2::DOUBLE', 4)} AS monthly_investment
FROM profiles LEFT JOIN incomes USING (user_id)
JOIN (VALUES {_STRATEGIES}) AS t(strategy, bonds, stocks, cash, expected_return, funds)
  ON strategy = CASE WHEN risk_tolerance IN ('conservative', 'moderate', 'aggressive') THEN risk_tolerance ELSE 'moderate' END"""))
def investment_plan(spark, sf_dir):
    out = planning.investment_plan(profiles(spark, sf_dir), _incomes(spark, sf_dir))
    return out.select(
        "user_id", "strategy", big("bonds"), big("stocks"), big("cash"), "expected_return", "funds", num("monthly_investment", 4)
    )


DEBTS = """debts AS (
  SELECT o_custkey AS user_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(6,4)) AS DECIMAL(18,2)) AS monthly_payment,
         l_discount AS interest_rate, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(with_(STAR, INCOMES, DEBTS, select=f"""
SELECT user_id, {dbl('SUM(amount)')} AS total_debt, {dbl('SUM(monthly_payment)')} AS total_monthly_payment,
       {r(rat('SUM(monthly_payment)', 'COALESCE(any_value(monthly_income), 0)'))} AS debt_to_income
FROM debts LEFT JOIN incomes USING (user_id) GROUP BY 1"""))
def debt_totals(spark, sf_dir):
    out = planning.debt_totals(debts(spark, sf_dir), _incomes(spark, sf_dir))
    return out.select("user_id", money("total_debt"), money("total_monthly_payment"), num("debt_to_income"))


def _ranking(order):
    return with_(DEBTS, select=f"""
SELECT user_id, k1 AS order_key, k2::BIGINT AS line_number, k3 AS part_key, k4 AS supp_key, {dbl('amount')} AS amount,
       {dbl('monthly_payment')} AS monthly_payment, interest_rate,
       row_number() OVER (PARTITION BY user_id ORDER BY {order}, k1, k2, k3, k4, amount) AS payoff_order FROM debts""")


def _ranked(spark, sf_dir, method):
    out = planning.debt_ranking(debts(spark, sf_dir), method)
    names = ("order_key", "line_number", "part_key", "supp_key")
    keys = [F.col(f"debt_id.k{i}").alias(n) for i, n in enumerate(names, 1)]
    return out.select(
        "user_id", *keys, money("amount"), money("monthly_payment"), "interest_rate", big("payoff_order")
    )


@query(_ranking("interest_rate DESC"))
def debt_ranking(spark, sf_dir):
    return _ranked(spark, sf_dir, "avalanche")


@query(_ranking("amount"))
def debt_ranking_snowball(spark, sf_dir):
    return _ranked(spark, sf_dir, "snowball")


@query(with_(STAR, PROFILES, select=f"""
SELECT user_id, {dbl("COALESCE(SUM(amount) FILTER (txn_type = 'income'), 0)")} AS total_income,
       {dbl("COALESCE(SUM(amount) FILTER (txn_type = 'expense'), 0)")} AS total_expenses, COUNT(*) AS transaction_count,
       string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
       COALESCE(any_value(employment_type), 'unknown') AS employment_type
FROM ledger LEFT JOIN profiles USING (user_id) GROUP BY 1"""))
def recommendation_context(spark, sf_dir):
    """Read back from the JSON text, so that the text itself is checked."""
    out = planning.recommendation_context(star_ledger(spark, sf_dir), profiles(spark, sf_dir))
    schema = (
        "financial_summary struct<total_income:double,total_expenses:double,transaction_count:bigint,"
        "categories:array<string>>,user_profile struct<employment_type:string>"
    )
    return out.select("user_id", F.from_json("context", schema).alias("c")).select(
        "user_id", "c.financial_summary.total_income", "c.financial_summary.total_expenses",
        "c.financial_summary.transaction_count",
        F.array_join("c.financial_summary.categories", ",").alias("categories"), "c.user_profile.employment_type",
    )


REPORT = with_(HOUSEHOLD, PROFILES, METRICS, RISKS, OVERALL, f"""lines AS (
  SELECT user_id, txn_type, COUNT(*)::HUGEINT AS n, SUM((total * 100)::HUGEINT)::HUGEINT AS sy,
         SUM((total * 100)::HUGEINT * x::HUGEINT)::HUGEINT AS sxy, SUM(x::HUGEINT)::HUGEINT AS sx,
         SUM(x::HUGEINT * x::HUGEINT)::HUGEINT AS sxx
  FROM series GROUP BY ALL),
ahead AS (
  SELECT user_id, txn_type, n, (n * sxy - sx * sy)::HUGEINT AS rise,
         CASE WHEN n >= 3 THEN (sy * sxx - sx * sxy + (n + 1) * (n * sxy - sx * sy))::HUGEINT::DOUBLE
              / (nullif(n * sxx - sx * sx, 0)::DOUBLE * 100.0) END AS next,
         CASE WHEN n >= 3 THEN (sy * sxx - sx * sxy + (n + 3) * (n * sxy - sx * sy))::HUGEINT::DOUBLE
              / (nullif(n * sxx - sx * sx, 0)::DOUBLE * 100.0) END AS third
  FROM lines),
fits AS (SELECT user_id, txn_type, COALESCE(regr_r2(y, x), 1) AS r2 FROM series GROUP BY ALL HAVING COUNT(*) >= 3),
words AS (
  SELECT *, CASE WHEN n < 3 THEN 'insufficient_data' WHEN rise > 0 THEN 'increasing' ELSE 'decreasing' END AS word,
         CASE WHEN n < 3 THEN 'insufficient_data' WHEN rise > 0 THEN 'increasing' WHEN rise < 0 THEN 'decreasing' ELSE 'stable' END AS word3
  FROM ahead),
cats AS (SELECT user_id, category, SUM(amount) AS total, COUNT(*) AS n, AVG(amount::DOUBLE) AS mean, stddev_pop(amount::DOUBLE) AS sd
         FROM ledger WHERE txn_type = 'expense' GROUP BY ALL),
maps AS (SELECT user_id, string_agg(category || '=' || n || '=' || CAST(total AS VARCHAR), ' ' ORDER BY category) AS categories FROM cats GROUP BY 1),
sources AS (SELECT user_id, string_agg(category || '=' || CAST(total AS VARCHAR), ' ' ORDER BY category) AS sources
            FROM (SELECT user_id, category, SUM(amount) AS total FROM ledger WHERE txn_type = 'income' GROUP BY ALL) GROUP BY 1),
trends AS (SELECT user_id, string_agg(strftime(month, '%Y-%m') || '=' || CAST(total AS VARCHAR), ' ' ORDER BY month) AS trends
           FROM months WHERE txn_type = 'expense' GROUP BY 1),
spans AS (SELECT user_id, MIN(y) AS lo, MAX(y) AS hi, CAST(SUM(total) AS DOUBLE) / COUNT(*) AS mean FROM series WHERE txn_type = 'income' GROUP BY 1 HAVING COUNT(*) >= 3),
seasons AS (SELECT user_id, month(ts) AS m, CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS v FROM ledger WHERE txn_type = 'income' GROUP BY ALL),
swing AS (SELECT user_id, stddev_samp(v) / AVG(v) AS cv, arg_max(m, v) AS peak FROM seasons GROUP BY 1 HAVING COUNT(*) >= 3),
daily AS (SELECT user_id, CAST(ts AS DATE) AS d, CAST(SUM(amount) AS DOUBLE) AS v FROM ledger WHERE txn_type = 'expense' GROUP BY ALL),
bars AS (SELECT user_id, quantile_cont(v, 0.9) AS bar FROM daily GROUP BY 1),
high AS (SELECT user_id, COUNT(*) FILTER (v > bar) AS n_high FROM daily JOIN bars USING (user_id) GROUP BY 1),
top AS (SELECT user_id, category, CAST(total AS DOUBLE) / CAST(SUM(total) OVER (PARTITION BY user_id) AS DOUBLE) * 100.0::DOUBLE AS share, COUNT(*) OVER (PARTITION BY user_id) AS n_categories,
        row_number() OVER (PARTITION BY user_id ORDER BY total DESC, category) AS rk FROM cats),
odd AS (SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (amount > mean + 4 * sd) AS n_high FROM ledger JOIN cats USING (user_id, category)
        WHERE txn_type = 'expense' AND cats.n >= 3 AND amount > mean + 3 * sd GROUP BY 1),
full_report AS (
  SELECT m.user_id, m.total_expenses::DOUBLE AS total_expenses, m.expense_months AS expenses_months, COALESCE(t.n_categories, 0) AS n_categories,
         t.category AS top_category, COALESCE(odd.n, 0) AS n_anomalies, m.total_income::DOUBLE AS total_income, m.income_months,
         CASE WHEN income_months >= 3 THEN {r('greatest(0, 1 - volatility)')} ELSE 0.5 END AS stability_score,
         COALESCE(i.word3, 'insufficient_data') AS trend,
         {SCORE} AS health_score, {r('savings_rate')} AS savings_rate, {r('expense_ratio')} AS expense_ratio,
         {r('volatility')} AS income_volatility,
         (savings_rate < 0.05)::BIGINT + (expense_ratio > 0.95)::BIGINT + (volatility > 0.4)::BIGINT AS n_risk_factors,
         (savings_rate < 0.1)::BIGINT + irregular::BIGINT AS n_recommendations,
         {r('i.next', 2)} AS next_income, COALESCE(i.word, 'insufficient_data') AS income_trend,
         {r('e.next', 2)} AS next_expenses, COALESCE(e.word, 'insufficient_data') AS expenses_trend,
         n_risks, overall_risk AS overall_risk_level, COALESCE(odd.n_high, 0) AS n_high_anomalies,
         COALESCE(maps.categories, '') AS category_analysis, COALESCE(trends.trends, '') AS monthly_trends, COALESCE(sources.sources, '') AS income_sources,
         concat_ws(' ', CASE WHEN t.share > 40 THEN 'concentration_risk' END, CASE WHEN high.n_high > 0 THEN 'high_spending_days' END) AS spending_insights,
         CASE WHEN high.n_high > 0 THEN high.n_high END AS n_high_days, spans.lo AS min_income, spans.hi AS max_income, {r('spans.mean', 4)} AS average_income,
         COALESCE(swing.cv > 0.3, FALSE) AS seasonality_detected, CASE WHEN swing.cv > 0.3 THEN CAST(swing.peak AS BIGINT) END AS peak_month,
         CASE WHEN i.n >= 3 THEN CASE WHEN i.n >= 6 THEN 'medium' ELSE 'low' END END AS confidence,
         {r('i.third', 2)} AS third_income, {r('e.third', 2)} AS third_expenses, {r('fi.r2')} AS income_r_squared, {r('fe.r2')} AS expenses_r_squared,
         n_risks AS n_mitigations
  FROM metrics m JOIN overall USING (user_id)
  LEFT JOIN words i ON i.user_id = m.user_id AND i.txn_type = 'income'
  LEFT JOIN words e ON e.user_id = m.user_id AND e.txn_type = 'expense'
  LEFT JOIN top t ON t.user_id = m.user_id AND t.rk = 1
  LEFT JOIN odd ON odd.user_id = m.user_id
  LEFT JOIN fits fi ON fi.user_id = m.user_id AND fi.txn_type = 'income'
  LEFT JOIN fits fe ON fe.user_id = m.user_id AND fe.txn_type = 'expense'
  LEFT JOIN maps ON maps.user_id = m.user_id LEFT JOIN sources ON sources.user_id = m.user_id LEFT JOIN trends ON trends.user_id = m.user_id
  LEFT JOIN spans ON spans.user_id = m.user_id LEFT JOIN swing ON swing.user_id = m.user_id LEFT JOIN high ON high.user_id = m.user_id)""", select="")


def _text(name, value):
    """A map as text, in order of its keys."""
    entries = F.transform(F.map_entries(name), lambda e: F.concat_ws("=", e["key"], value(e["value"])))
    return F.array_join(F.array_sort(entries), " ")


def _flat(report):
    return [
        "user_id", money("spending.total_expenses"), big("spending.expenses_months"), big("spending.n_categories"),
        "spending.top_category", big("spending.n_anomalies"), money("income.total_income"), big("income.income_months"),
        num("income.stability_score"), "income.trend", big("health.health_score"), num("health.savings_rate"),
        num("health.expense_ratio"), num("health.income_volatility"),
        F.when(F.col("health").isNotNull(), F.size("health.risk_factors")).cast("bigint").alias("n_risk_factors"),
        F.when(F.col("health").isNotNull(), F.size("recommendations")).cast("bigint").alias("n_recommendations"),
        num("predictions.next_income", 2), "predictions.income_trend", num("predictions.next_expenses", 2),
        "predictions.expenses_trend",
        F.when(F.col("health").isNotNull(), F.size("risk.risks")).cast("bigint").alias("n_risks"),
        "risk.overall_risk_level", big("spending.n_high_anomalies"),
        _text("spending.category_analysis", lambda v: F.concat_ws("=", v["count"].cast("string"), v["sum"].cast("string"))).alias("category_analysis"),
        _text("spending.monthly_trends", lambda v: v.cast("string")).alias("monthly_trends"),
        _text("income.income_sources", lambda v: v.cast("string")).alias("income_sources"),
        F.array_join(F.transform("spending.insights", lambda i: i["insight"]), " ").alias("spending_insights"),
        F.get(F.filter("spending.insights", lambda i: i["insight"] == "high_spending_days"), F.lit(0))["value"].cast("bigint").alias("n_high_days"),
        "income.min_income", "income.max_income", num("income.average_income", 4), "income.seasonality_detected",
        F.get("income.peak_months", F.lit(0)).cast("bigint").alias("peak_month"), "income.confidence",
        round_to(F.get("predictions.income", F.lit(2)), 2).alias("third_income"), round_to(F.get("predictions.expenses", F.lit(2)), 2).alias("third_expenses"),
        num("predictions.income_r_squared"), num("predictions.expenses_r_squared"),
        F.size("risk.mitigation").cast("bigint").alias("n_mitigations"),
    ]


@query(REPORT + "SELECT * FROM full_report", name="comprehensive_report")
def comprehensive(spark, sf_dir):
    out = comprehensive_report(household_ledger(spark, sf_dir), profiles(spark, sf_dir))
    return out.select(*_flat(out))


@query(REPORT + "SELECT * FROM full_report")
def report_refresh(spark, sf_dir):
    """The same reports after three batches, by years: each batch brings new reports to its own users only, the last one twice."""
    path, whole = shared_path(spark, "reports"), household_ledger(spark, sf_dir)
    year = F.year("ts")
    for batch, (low, high) in enumerate(((0, 1995), (1996, 1998), (1999, 9999))):
        for _ in range(1 + batch // 2):
            refresh_reports(whole.filter(year.between(low, high)), whole.filter(year <= high), profiles(spark, sf_dir), path, batch)
    return stored_reports(spark, path).select(*_flat(None))


@query(REPORT + """SELECT c_custkey AS user_id, CASE WHEN total_income IS NULL THEN 'No financial data available' END AS message,
       health_score, overall_risk_level FROM customer LEFT JOIN full_report ON user_id = c_custkey""")
def report_for_all_users(spark, sf_dir):
    """Every customer, those without transactions included."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    out = reports_for(users, household_ledger(spark, sf_dir), profiles(spark, sf_dir))
    return out.select("user_id", "message", big("health.health_score"), "risk.overall_risk_level")
