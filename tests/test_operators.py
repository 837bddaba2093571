"""Operators on small frames with values worked out by hand."""

import math

import pytest
from helpers import by_user
from pyspark.sql import functions as F

from tallyflow.functions import scoring
from tallyflow.operators import anomaly, goals, health, income, planning, recent, spending, tasks
from tallyflow.plans import insights
from tallyflow.plans.report import comprehensive_report, reports_for


def months(user, amounts, kind="income", start=2024):
    return [(user, kind, "Pay", a, f"{start + i // 12}-{i % 12 + 1:02d}-05") for i, a in enumerate(amounts)]


def test_empty_ledger_gives_no_rows(make_ledger, profiles, spark):
    empty = make_ledger([(1, "expense", "x", 1, "2024-01-01")]).limit(0)
    nobody = profiles((1, "gig", None))
    for frame in (
        spending.spending_summary(empty), spending.concentration(empty), spending.high_spending_days(empty),
        income.income_stability(empty), income.seasonality(empty), anomaly.category_outliers(empty),
        anomaly.spending_spikes(empty), anomaly.income_gaps(empty), insights.insight_feed(empty),
        comprehensive_report(empty, nobody), goals.goal_bundle(empty),
    ):
        assert frame.count() == 0


def test_spending_summary_of_income_only_user(make_ledger):
    ledger = make_ledger([(1, "income", "Pay", 10, "2024-01-01"), (2, "expense", "Food", 3, "2024-01-01"), (2, "expense", "Food", 5, "2024-03-01")])
    rows = by_user(spending.spending_summary(ledger))
    assert rows[1]["category_spending"] == {} and rows[1]["average_monthly"] == 0.0 and rows[1]["total_expenses"] == 0
    assert {k: float(v) for k, v in rows[2]["monthly_trends"].items()} == {"2024-01": 3.0, "2024-03": 5.0}
    assert rows[2]["average_monthly"] == 4.0  # February is not filled with zero


def test_category_ties_go_by_name(make_ledger):
    ledger = make_ledger([(1, "expense", "B", 50, "2024-01-01"), (1, "expense", "A", 50, "2024-01-02")])
    top = by_user(spending.concentration(ledger), "top_category", "top_percent")
    assert top == {1: ("A", 50.0)}


def test_high_spending_days_interpolates(make_ledger):
    ledger = make_ledger([(1, "expense", "x", a, f"2024-01-{i + 1:02d}") for i, a in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10])])
    row = by_user(spending.high_spending_days(ledger), "threshold", "n_high_days")[1]
    assert row[0] == pytest.approx(9.1) and row[1] == 1


def test_income_stability_by_number_of_months(make_ledger):
    ledger = make_ledger(months(1, [100, 100]) + months(2, [100, 200, 300]) + months(3, [100, 100, 100]) + months(4, [30, 20, 10]))
    rows = by_user(income.income_stability(ledger), "stability_score", "volatility", "trend", "average_income")
    assert rows[1] == (0.5, 0.0, "insufficient_data", None)
    assert rows[2] == (pytest.approx(0.5), pytest.approx(0.5), "increasing", 200.0)
    assert rows[3] == (1.0, 0.0, "stable", 100.0)
    assert rows[4][2] == "decreasing"


def test_volatility_sample_and_population(make_ledger):
    ledger = make_ledger(months(1, [100, 300]) + months(2, [100]))
    assert by_user(income.income_volatility(ledger), "volatility") == {1: (pytest.approx(math.sqrt(20000) / 200),), 2: (0.0,)}
    assert by_user(income.income_volatility_population(ledger), "volatility", "stability_score")[1] == (0.5, 0.5)


def test_variability_labels(make_ledger):
    ledger = make_ledger(months(1, [100, 100]) + months(2, [100, 150]) + months(3, [100, 400]) + months(4, [0, 0]))
    rows = by_user(income.income_variability(ledger), "income_stability")
    assert rows == {1: ("stable",), 2: ("moderate",), 3: ("highly_variable",), 4: ("stable",)}


def test_projection_skips_a_month(make_ledger):
    ledger = make_ledger(months(1, [10, 20, 30]) + months(2, [5] * 6) + months(3, [1, 2]))
    rows = by_user(income.income_projection(ledger), "projection", "next_3_months", "trend_slope", "confidence")
    assert rows[1] == ("available", [50.0, 60.0, 70.0], 10.0, "low")  # x = 4, 5, 6 and not 3, 4, 5
    assert rows[2] == ("available", [5.0, 5.0, 5.0], 0.0, "medium")
    assert rows[3] == ("insufficient_data", None, None, None)


def test_flat_series_counts_as_decreasing(make_ledger):
    rows = by_user(income.series_predictions(make_ledger(months(1, [5, 5, 5], "expense"))), "trend", "r_squared", "error")
    assert rows[1] == ("decreasing", 1.0, None)


def test_trend_equals_numpy(make_ledger):
    import numpy as np

    y = [12.34, 99.9, 5.01, 77.7, 65.43, 8.88, 120.0]
    row = by_user(income.linear_trends(make_ledger(months(1, y))), "slope", "intercept")[1]
    assert row == pytest.approx(tuple(np.polyfit(range(len(y)), y, 1)))


def test_seasonality(make_ledger):
    even = months(1, [10, 10, 10])
    uneven = months(2, [10, 100, 100, 10, 50])
    merged = [(3, "income", "p", 10, "2023-01-01"), (3, "income", "p", 90, "2024-01-01"), (3, "income", "p", 1, "2024-02-01")]
    rows = by_user(income.seasonality(make_ledger(even + uneven + merged)), "seasonality_detected", "peak_months", "low_months", "n_months")
    assert rows[1] == (False, None, None, 3)
    assert rows[2] == (True, [2, 3, 5], [1, 4, 5], 5)  # equal means: the earlier month first
    assert rows[3] == (False, None, None, 2)  # January of both years is one month


@pytest.mark.parametrize("n, found", [(10, 0), (11, 1)])
def test_three_sigma_needs_eleven_rows(make_ledger, n, found):
    ledger = make_ledger([(1, "expense", "x", 1, f"2024-01-{i + 1:02d}") for i in range(n - 1)] + [(1, "expense", "x", 50.01, "2024-02-01")])
    assert anomaly.category_outliers(ledger).count() == found


@pytest.mark.parametrize("n, severity", [(17, "medium"), (18, "high")])
def test_four_sigma_needs_eighteen_rows(make_ledger, n, severity):
    ledger = make_ledger([(1, "expense", "x", 0.1, f"2024-01-{i + 1:02d}") for i in range(n - 1)] + [(1, "expense", "x", 9, "2024-02-01")])
    assert [r["severity"] for r in anomaly.category_outliers(ledger).collect()] == [severity]


def test_equal_amounts_are_never_outliers(make_ledger):
    ledger = make_ledger([(1, "expense", "x", 0.1, f"2024-01-{i + 1:02d}") for i in range(28)])
    assert anomaly.category_outliers(ledger, times=0.0).count() == 0
    assert anomaly.spending_spikes(ledger, times=0.0).count() == 0


def test_spike_of_exactly_two_sigma_is_none(make_ledger):
    rows = [(1, "expense", "x", 12.34, f"2024-01-{i + 1:02d}") for i in range(4)]
    assert anomaly.spending_spikes(make_ledger(rows + [(1, "expense", "x", 99.99, "2024-01-09")])).count() == 0  # n = 5
    rows.append((1, "expense", "x", 12.34, "2024-01-08"))
    assert anomaly.spending_spikes(make_ledger(rows + [(1, "expense", "x", 99.99, "2024-01-09")])).count() == 1  # n = 6


def test_income_gaps(make_ledger):
    ledger = make_ledger(months(1, [1, 1, 1]) + months(2, [1, 1]) + [(3, "income", "p", 1, f"2024-01-{d:02d}") for d in (1, 2, 3)])
    rows = by_user(anomaly.income_gaps(ledger), "mean_gap_days", "alert")
    assert rows == {1: (30.0, True), 3: (1.0, False)}


def test_spending_trend_windows(make_ledger):
    ledger = make_ledger([
        (1, "expense", "x", 100, "2024-01-31 12:00:00"), (1, "expense", "x", 10, "2024-01-01 12:00:00"),
        (1, "expense", "x", 55, "2024-01-01 11:59:59"), (1, "expense", "x", 7, "2023-12-02 11:59:59"),
        (2, "expense", "x", 1, "2024-01-01"),
    ])
    row = by_user(anomaly.spending_trend(ledger), "recent_total", "previous_total", "change_percent")
    assert {k: tuple(map(float, v)) for k, v in row.items()} == {1: (110.0, 55.0, 100.0)}


@pytest.mark.parametrize("savings, ratio, vol, job, app, agent", [
    (0.0, 0.0, 0.0, None, 75, 65),  # no income at all is not a low score
    (0.2, 0.7, 0.1, "formal", 100, 95),
    (0.1, 0.85, 0.2, "gig", 72, 70),
    (0.05, 0.95, 0.3, "informal", 53, 55),
    (0.049, 0.951, 0.31, "gig", 40, 40),
])
def test_scores_at_thresholds(spark, savings, ratio, vol, job, app, agent):
    df = spark.createDataFrame([(savings, ratio, vol, job)], "s double, r double, v double, j string")
    s, r, v, j = (F.col(c) for c in "srvj")
    row = df.select(scoring.health_score(s, r, v, j), scoring.agent_health_score(s, v, j)).first()
    assert tuple(row) == (app, agent)


@pytest.mark.parametrize("percent, score", [(60, 100), (20, 85), (19.9, 80), (10, 70), (5, 50), (4.9, 99), (0, 50), (-5, 0), (-80, 0)])
def test_dashboard_score_is_not_monotonic(spark, percent, score):
    df = spark.createDataFrame([(float(percent),)], "p double")
    assert df.select(scoring.dashboard_score(F.col("p"))).first()[0] == score


def test_overspending_is_strict_and_needs_both_types(make_ledger, profiles):
    ledger = make_ledger([
        (1, "income", "p", 100, "2024-01-01"), (1, "expense", "x", 90, "2024-01-02"),
        (2, "income", "p", 100, "2024-01-01"), (2, "expense", "x", 90.01, "2024-01-02"),
        (3, "expense", "x", 90, "2024-01-02"),
    ])
    out = health.risk_assessment(ledger, profiles((3, "gig", None))).collect()
    assert {(r["user_id"], r["risk"]) for r in out} == {(2, "overspending"), (3, "emergency_fund")}


def test_overall_risk_levels(make_ledger, profiles):
    ledger = make_ledger(months(1, [100, 100]) + months(2, [100, 160]) + months(3, [100, 400]) + months(4, [100, 400]))
    out = by_user(health.overall_risk(ledger, profiles((4, "gig", None))), "overall_risk")
    assert out == {1: ("low",), 2: ("low-medium",), 3: ("high",), 4: ("very_high",)}
    plan = health.mitigation_plan(ledger, profiles((4, "gig", None))).filter("user_id = 4")
    assert {(r["risk"], r["priority"]) for r in plan.collect()} == {("income_volatility", "high"), ("emergency_fund", "medium")}


def test_recommendations_without_profile(make_ledger, profiles):
    ledger = make_ledger([(1, "expense", "x", 5, "2024-01-01"), (2, "income", "p", 5, "2024-01-01")])
    out = health.recommendations(ledger, profiles((9, "gig", None))).collect()
    assert [(r["user_id"], r["category"]) for r in out] == [(1, "savings")]


def test_goals(make_ledger):
    ledger = make_ledger([
        (1, "income", "Investment", 700, "2024-01-01"), (1, "expense", "Loan", 50, "2023-01-01"),
        (1, "expense", "CREDIT CARD", 50, "2024-01-01"), (2, "income", "p", 5, "2024-01-01"),
        (3, "expense", "x", 100, "2024-01-01"), (3, "expense", "x", 100, "2024-02-01"),
    ])
    rows = by_user(goals.goal_bundle(ledger))
    fund = rows[1]["emergency_fund"]  # both Januaries are one month: 100 a month
    assert (fund["status"], float(fund["current_savings"]), fund["target_amount"], fund["months_covered"]) == ("on_track", 600.0, 600.0, 6)
    assert (float(rows[1]["debt_reduction"]["total_debt_payments"]), rows[1]["debt_reduction"]["payment_frequency"]) == (100.0, 2)
    assert float(rows[1]["investment_goals"]["total_invested"]) == 700.0
    assert rows[2]["emergency_fund"]["status"] == "no_data" and rows[2]["emergency_fund"]["months_covered"] is None
    assert rows[3]["emergency_fund"]["months_covered"] == -2 and rows[3]["emergency_fund"]["status"] == "in_progress"
    assert rows[3]["debt_reduction"]["status"] == "no_debt_detected"


def test_budget(make_ledger, spark):
    ledger = make_ledger([(1, "expense", "a", 100, "2024-01-01"), (1, "expense", "b", 101, "2024-01-01"), (2, "expense", "a", 1, "2024-01-01")])
    incomes = spark.createDataFrame([(1, 1000.0), (3, 10.0)], "user_id bigint, monthly_income double")
    budgets = {(r["user_id"], r["category"]): r["budget"] for r in planning.category_budgets(ledger, incomes).collect()}
    assert budgets == {(1, "a"): 100.0, (1, "b"): pytest.approx(85.85), (2, "a"): 0.85}
    plan = by_user(planning.budget_plan(ledger, incomes), "needs", "wants", "savings")
    assert plan == {1: (500.0, 300.0, 200.0), 2: (None, None, None), 3: (5.0, 3.0, 2.0)}


def test_investment_plan_defaults_to_moderate(profiles, spark):
    incomes = spark.createDataFrame([(1, 1000.0)], "user_id bigint, monthly_income double")
    people = profiles((1, None, "aggressive"), (2, None, "low"), (3, None, None))
    rows = by_user(planning.investment_plan(people, incomes), "strategy", "stocks", "monthly_investment")
    assert rows == {1: ("aggressive", 70, 200.0), 2: ("moderate", 50, 0.0), 3: ("moderate", 50, 0.0)}


def test_insight_feed(make_ledger):
    ledger = make_ledger(
        [(1, "income", "p", 1, "2024-01-01"), (1, "income", "p", 1, "2024-01-01")]
        + [(2, "expense", "Dining", 101, f"2024-01-{d:02d}") for d in range(1, 13)]
        + [(2, "expense", "Rent", 2000, "2024-01-31"), (2, "expense", "Travel", 2000, "2024-02-20"), (2, "income", "p", 5400, "2024-01-01")]
    )
    rows = [(r["user_id"], r["rank"], r["insight_type"], r["priority"], r["subject"]) for r in insights.insight_feed(ledger).orderBy("user_id", "rank").collect()]
    assert rows == [
        (1, 0, "welcome", "low", None),
        (2, 1, "spending_pattern", "medium", "Rent"),
        (2, 2, "savings_alert", "high", None),
        (2, 3, "trend_alert", "medium", None),
        (2, 4, "anomaly_detection", "medium", "Rent"),  # equally large: the earlier one
        (2, 5, "recommendation", "low", "Dining"),
    ]
    assert insights.insight_text(insights.insight_feed(ledger)).filter("content IS NULL").count() == 0


def test_latest_rows_and_listing(make_ledger):
    ledger = make_ledger([(1, "expense", "x", d, f"2024-01-{d:02d}") for d in range(1, 26)])
    assert [r["rank"] for r in recent.latest_rows(ledger, 20).orderBy("rank").collect()] == list(range(1, 21))
    summary = by_user(recent.recent_summary(ledger), "n_rows", "recent_expenses")[1]
    assert (summary[0], float(summary[1])) == (20, float(sum(range(6, 26))))
    listing = sorted(recent.api_rows(recent.newest_first(ledger)).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in listing] == list(range(1, 26)) and listing[0]["date"] == "2024-01-25T00:00:00"


def test_report_covers_users_without_rows(make_ledger, profiles, spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    ledger = make_ledger(months(1, [10, 20, 30]))
    rows = by_user(reports_for(users, ledger, profiles((1, "gig", None))))
    assert rows[2]["message"] == "No financial data available" and rows[2]["health"] is None
    assert rows[1]["predictions"]["next_income"] == 50.0 and rows[1]["health"]["health_score"] == 80


def steps(spark, *rows):
    return spark.createDataFrame(list(rows), "workflow_id bigint, step bigint, agent_type string, success boolean, result string")


def test_collaboration_and_workflow(spark):
    frame = steps(
        spark, (1, 0, "financial", True, "a"), (1, 1, "research", False, "b"), (2, 0, "financial", True, "c"),
        (2, 1, "nobody", True, "d"), (2, 2, "learning", True, "e"), (3, 0, "nobody", True, None),
    )
    runs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "workflow_id bigint")
    out = {r[0]: tuple(r)[1:] for r in tasks.collaboration_outcomes(frame, runs).collect()}
    assert out == {1: (2, False, True), 2: (3, False, True), 3: (1, False, False), 4: (0, True, False)}
    done = {r["workflow_id"]: (r["current_step"], r["n_failed_tasks"], r["next_agent"], r["status"]) for r in tasks.workflow_progress(frame).collect()}
    assert done == {1: (2, 1, None, "completed"), 2: (1, 0, "nobody", "failed"), 3: (0, 0, "nobody", "failed")}
    assert {(r["workflow_id"], r["result"]) for r in tasks.previous_results(frame).collect()} == {(1, "a"), (1, "b"), (2, "c")}


def test_task_status_of_malformed_results(spark):
    rows = [(1, "financial", '{"success": true}'), (2, "financial", '{"success": false}'), (3, "financial", '{"succ'), (4, "financial", None),
            (5, "nobody", '{"success": true}'), (6, None, '{"success": true}'), (7, "learning", '{"error": "x"}')]
    frame = spark.createDataFrame(rows, "task_id bigint, agent_type string, result string")
    out = {r["task_id"]: r["status"] for r in tasks.task_status(frame).collect()}
    assert out == {1: "completed", 2: "failed", 3: "failed", 4: "pending", 5: "failed", 6: "completed", 7: "failed"}


def test_agents_without_tasks_are_listed(spark):
    frame = spark.createDataFrame([("financial", True), ("financial", False), ("nobody", True)], "agent_type string, success boolean")
    out = {r[0]: tuple(r)[1:] for r in tasks.agent_performance(frame).collect()}
    assert out == {"financial": (2, 0.5), "research": (0, 0.0), "productivity": (0, 0.0), "learning": (0, 0.0)}
