"""Health, risk, recommendation and goal queries."""

from pyspark.sql import functions as F

from tallyflow.catalog.registry import HOUSEHOLD, METRICS, PROFILES, STAR, big, dbl, money, num, query, r, rat, with_
from tallyflow.functions import fixed_values as fv
from tallyflow.operators import goals, health
from tallyflow.sources.star import household_ledger, profiles, star_ledger


def _ledger(spark, sf_dir):
    return star_ledger(spark, sf_dir, with_category=False)


@query(with_(STAR, PROFILES, METRICS, select=f"""
SELECT user_id, {dbl('total_income')} AS total_income, {dbl('total_expenses')} AS total_expenses,
       {r('savings_rate')} AS savings_rate, {r('expense_ratio')} AS expense_ratio FROM metrics"""))
def cash_flow(spark, sf_dir):
    out = health.cash_flow(_ledger(spark, sf_dir))
    return out.select(
        "user_id", money("total_income"), money("total_expenses"), num("savings_rate"), num("expense_ratio")
    )


SAVINGS_25 = "CASE WHEN savings_rate >= 0.2 THEN 25 WHEN savings_rate >= 0.1 THEN 15 WHEN savings_rate >= 0.05 THEN 5 ELSE 0 END"
RATIO_15 = "CASE WHEN expense_ratio <= 0.7 THEN 15 WHEN expense_ratio <= 0.85 THEN 10 WHEN expense_ratio <= 0.95 THEN 5 ELSE 0 END"
VOL_10 = "CASE WHEN volatility <= 0.1 THEN 10 WHEN volatility <= 0.2 THEN 7 WHEN volatility <= 0.3 THEN 3 ELSE 0 END"
SAVINGS_30 = "CASE WHEN savings_rate >= 0.2 THEN 30 WHEN savings_rate >= 0.1 THEN 20 WHEN savings_rate >= 0.05 THEN 10 ELSE 0 END"
VOL_15 = "CASE WHEN volatility_pop <= 0.1 THEN 15 WHEN volatility_pop <= 0.2 THEN 10 WHEN volatility_pop <= 0.3 THEN 5 ELSE 0 END"
PENALTY = "CASE WHEN irregular THEN 10 ELSE 0 END"
SCORE = f"CAST(greatest(0, least(100, 50 + {SAVINGS_25} + {RATIO_15} + {VOL_10} - {PENALTY})) AS BIGINT)"
AGENT = f"CAST(greatest(0, least(100, 50 + {SAVINGS_30} + {VOL_15} - {PENALTY})) AS BIGINT)"
PERCENT = "(savings_rate * 100.0::DOUBLE)"
DASH = f"""CAST(floor(CASE WHEN {PERCENT} >= 20 THEN 85 + least(15, {PERCENT} - 20) WHEN {PERCENT} >= 10 THEN 70 + ({PERCENT} - 10)
  WHEN {PERCENT} >= 5 THEN 50 + ({PERCENT} - 5) * 4 ELSE greatest(0, 50 + {PERCENT} * 10) END + 0.5) AS BIGINT)"""


@query(with_(STAR, PROFILES, METRICS, select=f"""
SELECT user_id, {r('savings_rate')} AS savings_rate, {r('expense_ratio')} AS expense_ratio,
       {r('volatility')} AS income_volatility, {SCORE} AS health_score FROM metrics"""))
def health_score(spark, sf_dir):
    out = health.health_scores(_ledger(spark, sf_dir), profiles(spark, sf_dir))
    return out.select(
        "user_id", num("savings_rate"), num("expense_ratio"), num("income_volatility"), big("health_score")
    )


@query(with_(STAR, PROFILES, METRICS, select=f"SELECT user_id, {AGENT} AS agent_score FROM metrics"))
def health_score_agent(spark, sf_dir):
    out = health.health_scores(_ledger(spark, sf_dir), profiles(spark, sf_dir))
    return out.select("user_id", big("agent_score"))


@query(with_(STAR, PROFILES, METRICS, select=f"SELECT user_id, {DASH} AS dashboard_score FROM metrics"))
def dashboard_score(spark, sf_dir):
    out = health.health_scores(_ledger(spark, sf_dir), profiles(spark, sf_dir))
    return out.select("user_id", big("dashboard_score"))


@query(with_(STAR, PROFILES, METRICS, select="""
SELECT user_id, 'low_savings' AS risk, 'high' AS severity FROM metrics WHERE savings_rate < 0.05
UNION ALL SELECT user_id, 'high_expenses', 'high' FROM metrics WHERE expense_ratio > 0.95
UNION ALL SELECT user_id, 'high_volatility', 'medium' FROM metrics WHERE volatility > 0.4"""))
def risk_factors(spark, sf_dir):
    return health.risk_factors(_ledger(spark, sf_dir))


RISKS = """risks AS (
  SELECT user_id, 'income_volatility' AS risk, CASE WHEN volatility > 0.5 THEN 'high' ELSE 'medium' END AS severity
  FROM metrics WHERE income_months > 0 AND volatility > 0.3
  UNION ALL SELECT user_id, 'overspending', 'high' FROM metrics
  WHERE income_months > 0 AND expense_months > 0 AND CAST(total_expenses AS DOUBLE) > CAST(total_income AS DOUBLE) * 0.9::DOUBLE
  UNION ALL SELECT user_id, 'emergency_fund', 'high' FROM metrics WHERE irregular)"""


@query(with_(STAR, PROFILES, METRICS, RISKS, select="SELECT user_id, risk, severity FROM risks"))
def risk_assessment(spark, sf_dir):
    return health.risk_assessment(_ledger(spark, sf_dir), profiles(spark, sf_dir))


OVERALL = """levels AS (
  SELECT metrics.user_id, COUNT(risk) AS n_risks, COUNT(*) FILTER (severity = 'high') AS hi, COUNT(*) FILTER (severity = 'medium') AS me
  FROM metrics LEFT JOIN risks USING (user_id) GROUP BY 1),
overall AS (
  SELECT user_id, n_risks, CASE WHEN hi >= 2 THEN 'very_high' WHEN hi = 1 THEN 'high' WHEN me >= 2 THEN 'medium'
         WHEN me = 1 THEN 'low-medium' ELSE 'low' END AS overall_risk FROM levels)"""


@query(with_(STAR, PROFILES, METRICS, RISKS, OVERALL, select="SELECT user_id, n_risks, overall_risk FROM overall"))
def overall_risk(spark, sf_dir):
    out = health.overall_risk(_ledger(spark, sf_dir), profiles(spark, sf_dir))
    return out.select("user_id", big("n_risks"), "overall_risk")


_PLAN = ", ".join(str(m) for m in fv.MITIGATIONS)


@query(with_(STAR, PROFILES, METRICS, RISKS, select=f"""
SELECT user_id, risk, strategy, timeline, priority
FROM risks JOIN (VALUES {_PLAN}) AS t(kind, strategy, timeline, priority) ON risk = kind"""))
def mitigation_plan(spark, sf_dir):
    return health.mitigation_plan(_ledger(spark, sf_dir), profiles(spark, sf_dir))


def _row(values):
    return ", ".join(f"'{v}' AS {n}" for n, v in zip(("category", "priority", "action", "impact", "timeline"), values))


@query(with_(STAR, PROFILES, METRICS, select=f"""
SELECT user_id, {_row(fv.SAVINGS_RECOMMENDATION)} FROM metrics WHERE savings_rate < 0.1
UNION ALL SELECT user_id, {_row(fv.EMERGENCY_RECOMMENDATION)} FROM metrics WHERE irregular"""))
def recommendations(spark, sf_dir):
    return health.recommendations(_ledger(spark, sf_dir), profiles(spark, sf_dir))


GOALS = """goals AS (
  SELECT user_id, COALESCE(SUM(amount) FILTER (txn_type = 'income'), 0) AS income,
         COALESCE(SUM(amount) FILTER (txn_type = 'expense'), 0) AS spent,
         COUNT(*) FILTER (txn_type = 'expense') AS n_expense,
         COUNT(DISTINCT month(ts)) FILTER (txn_type = 'expense') AS n_months,
         SUM(amount) FILTER (lower(category) IN ('debt', 'loan', 'credit card')) AS debt,
         COUNT(*) FILTER (lower(category) IN ('debt', 'loan', 'credit card')) AS n_debt,
         SUM(amount) FILTER (lower(category) IN ('investment', 'stocks', 'retirement')) AS invested,
         COUNT(*) FILTER (lower(category) IN ('investment', 'stocks', 'retirement')) AS n_invested
  FROM ledger GROUP BY 1),
fund AS (
  SELECT *, CAST(income - spent AS DOUBLE) AS saved, CAST(spent AS DOUBLE) / greatest(1, n_months) AS monthly FROM goals),
progress AS (
  SELECT *, monthly * 6 AS target, CASE WHEN monthly * 6 > 0 THEN saved / (monthly * 6) * 100.0 ELSE 0.0 END AS pct FROM fund)"""
FUND = f"""CASE WHEN n_expense = 0 THEN 'no_data' WHEN pct >= 100 THEN 'on_track' ELSE 'in_progress' END AS status,
       CASE WHEN n_expense > 0 THEN saved END AS current_savings, CASE WHEN n_expense > 0 THEN {r('target', 4)} END AS target_amount,
       CASE WHEN n_expense > 0 THEN {r('pct')} END AS progress_percentage,
       CASE WHEN n_expense > 0 THEN CASE WHEN monthly > 0 THEN CAST(trunc(saved / monthly) AS BIGINT) ELSE 0 END END AS months_covered"""


@query(with_(STAR, GOALS, select=f"SELECT user_id, {FUND} FROM progress"))
def goal_emergency_fund(spark, sf_dir):
    out = goals.emergency_fund(_ledger(spark, sf_dir))
    return out.select(
        "user_id", "status", money("current_savings"), num("target_amount", 4), num("progress_percentage"),
        big("months_covered"),
    )


@query(with_(STAR, GOALS, select=f"""
SELECT user_id, {r(rat('income - spent', 'income'))} AS savings_rate, saved AS total_saved FROM fund"""))
def goal_savings(spark, sf_dir):
    return goals.savings_goal(_ledger(spark, sf_dir)).select("user_id", num("savings_rate"), money("total_saved"))


@query(with_(HOUSEHOLD, GOALS, select=f"""
SELECT user_id, CASE WHEN n_debt > 0 THEN 'detected' ELSE 'no_debt_detected' END AS status, {dbl('debt')} AS total_debt_payments,
       CASE WHEN n_debt > 0 THEN n_debt END AS payment_frequency FROM goals"""))
def goal_debt(spark, sf_dir):
    out = goals.debt_goal(household_ledger(spark, sf_dir))
    return out.select("user_id", "status", money("total_debt_payments"), big("payment_frequency"))


@query(with_(HOUSEHOLD, GOALS, select=f"""
SELECT user_id, CASE WHEN n_invested > 0 THEN 'detected' ELSE 'no_investments_detected' END AS status, {dbl('invested')} AS total_invested,
       CASE WHEN n_invested > 0 THEN n_invested END AS investment_frequency FROM goals"""))
def goal_investment(spark, sf_dir):
    out = goals.investment_goal(household_ledger(spark, sf_dir))
    return out.select("user_id", "status", money("total_invested"), big("investment_frequency"))


@query(with_(HOUSEHOLD, GOALS, select=f"""
SELECT user_id, {FUND}, {r(rat('income - spent', 'income'))} AS savings_rate, {dbl('debt')} AS total_debt_payments,
       {dbl('invested')} AS total_invested FROM progress"""))
def goal_bundle(spark, sf_dir):
    out = goals.goal_bundle(household_ledger(spark, sf_dir))
    return out.select(
        "user_id", F.col("emergency_fund.status"), money("emergency_fund.current_savings"),
        num("emergency_fund.target_amount", 4), num("emergency_fund.progress_percentage"),
        big("emergency_fund.months_covered"), num("savings_goals.savings_rate"),
        money("debt_reduction.total_debt_payments"), money("investment_goals.total_invested"),
    )
