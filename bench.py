"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Every query is run once to warm up and then REPEATS times (one by default) into the noop sink, so all rows are produced and none
are collected. The figure of a query is its median; the metric is their sum. A query that fails is named
in `failed`, has no figure, and is not in the sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyflow.catalog import QUERIES  # noqa: E402
from tallyflow.session import build_session  # noqa: E402

HEADLINE = (
    "category_totals category_stats monthly_totals spending_summary concentration high_spend_days income_variability "
    "income_stability income_projection series_prediction seasonality cash_flow health_score risk_assessment "
    "mitigation_plan recommendations goal_bundle anomalies_3sd anomalies_2sd spending_trend_30d spending_spikes income_gaps "
    "insights_feed recent_topk budget_plan debt_ranking comprehensive_report categorize_text statement_import feed_dedup "
    "agent_performance agent_running_success task_latest workflow_progress advice_extract"
).split()
REPEATS = int(os.environ.get("BENCH_REPEATS", "1"))


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, failed = {}, {}
    for name in names:
        try:
            run(spark, name, sf_dir)
            times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(REPEATS)), 3)
        except Exception as error:  # the other queries still have figures
            failed[name] = str(error).strip().splitlines()[0][:200]
    spark.stop()
    print(json.dumps({
        "metric": "sum of median seconds of the headline queries, warm, noop sink",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "failed": failed,
    }))


if __name__ == "__main__":
    main()
