"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line.

The test tables are first mapped onto the lake's shapes and landed, as a lake holds them: Parquet by year, month and day
(and JSON batches for flattening). This mapping is timed apart, as ``landing``. Then all queries are run once to warm up,
and each $BENCH_RUNS times; its time is the median. Results are written to the ``noop`` sink, so every row and column
is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from lakepulse import views
from lakepulse.checks.analyses import AT
from lakepulse.operators.flatten import flatten_events
from lakepulse.plans import engagement, monitoring
from lakepulse.session import clear_scratch, local_session, scratch
from lakepulse.sources import fixture, lake, sinks
from lakepulse.sources.fixture import AS_OF

DAY = ["year", "month", "day"]
FLAT = {
    "anxiety_flow_effectiveness": "anxiety_management_flow_effectiveness",
    "user_retention_churn": "user_retention_churn_analysis",
    "response_effectiveness": "response_effectiveness_analysis",
    "response_trend": "response_trend_analysis",
    "user_engagement": "user_engagement_analytics",
    "dau_alerts": "daily_alerts",
    "new_vs_returning": "new_vs_returning_users",
    "anxiety_trend": "anxiety_improvement_tracking",
    "wellness_journey": "user_wellness_journey",
} | {
    name: name
    for name in (
        "daily_active_users", "event_type_overview", "focus_session_analytics", "screen_navigation_analytics",
        "session_engagement_metrics", "session_timing_patterns", "treatment_completion_analysis", "user_journey_funnel",
        "crisis_intervention_detection", "engagement_activity_based", "engagement_retention_based",
    )
}
EVENTS = {
    "daily_aggregates": "daily_aggregates",
    "daily_retention": "daily_retention",
    "daily_top_features": "daily_top_features",
    "daily_metrics_mart": "daily_metrics",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", cpus)), app="bench")

    def landed(name, rows, keys=()):
        path = scratch(spark, name)
        rows.write.partitionBy(*keys).parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    began = time.perf_counter()
    flat = landed("flat", fixture.flat(spark, sf_dir), DAY)
    events = landed("product-events", fixture.mart_events(flat), DAY)
    http = landed("http", fixture.http_metrics(spark, sf_dir))
    log = landed("log", fixture.message_log(spark, sf_dir))
    batches = scratch(spark, "batches")
    sinks.write_json(fixture.batches(spark, sf_dir), batches, DAY)
    landing = round(time.perf_counter() - began, 3)

    headline = {key: (lambda n=name: views.run(n, flat, AS_OF)) for key, name in FLAT.items()}
    headline |= {key: (lambda n=name: views.run(n, events, AS_OF)) for key, name in EVENTS.items()}
    headline |= {
        "engagement_session_based": lambda: engagement.session_based(flat, AT),
        "alarm_error_rate": lambda: monitoring.alarm_error_rate(http),
        "alarm_queue_depth": lambda: monitoring.alarm_queue_depth(log),
        "queue_health": lambda: monitoring.queue_health(log),
        "flatten_events": lambda: flatten_events(lake.read_batches(spark, batches)),
    }
    names = os.environ.get("BENCH_QUERIES", "").split() or sorted(headline)

    def run(name: str) -> float:
        began = time.perf_counter()
        headline[name]().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for name in names:
        run(name)
    seconds = {name: round(statistics.median(run(name) for _ in range(runs)), 3) for name in names}
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "landing": landing,
             "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}
        )
    )
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
