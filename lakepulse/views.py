"""Tables, views and named queries, as a catalog of the lake offers them."""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import DataFrame, SparkSession

from lakepulse.operators.flatten import flatten_events
from lakepulse.plans import activity, churn, engagement, focus, mart, responses, risk, sessions
from lakepulse.session import pin
from lakepulse.sources import lake

READERS = {
    "analytics": lake.read_batches,
    "user_behavior": lake.read_user_behavior,
    "feedback": lake.read_feedback,
    "transactions": lake.read_transactions,
    "raw_events": lake.read_raw_events,
}

# Each takes (flat, as_of); flat is the flattened view or its compacted Parquet form.
NAMED_QUERIES = {
    "daily_active_users": activity.daily_active_users,
    "event_type_overview": activity.event_type_overview,
    "focus_session_analytics": focus.focus_sessions,
    "screen_navigation_analytics": activity.screen_navigation,
    "session_engagement_metrics": sessions.session_engagement,
    "session_timing_patterns": focus.session_timing,
    "treatment_completion_analysis": sessions.treatment_completion,
    "user_journey_funnel": sessions.user_journey_funnel,
    "anxiety_management_flow_effectiveness": sessions.anxiety_flow_effectiveness,
    "crisis_intervention_detection": risk.crisis_intervention,
    "user_retention_churn_analysis": churn.retention_churn,
    "user_engagement_analytics": activity.user_engagement,
    "response_effectiveness_analysis": responses.response_effectiveness,
    "response_trend_analysis": responses.response_trend,
    "anxiety_improvement_tracking": responses.anxiety_trend,
    "user_wellness_journey": responses.wellness_journey,
    "daily_alerts": activity.dau_alerts,
    "new_vs_returning_users": activity.new_vs_returning,
    "engagement_activity_based": engagement.activity_based,
    "engagement_retention_based": engagement.retention_based,
    "engagement_session_based": lambda flat, as_of: engagement.session_based(flat, end_of(as_of)),
}


# Each takes (events, as_of), events in the product-event shape.
EVENT_QUERIES = {
    "daily_aggregates": mart.daily_aggregates,
    "daily_retention": mart.daily_retention,
    "daily_top_features": mart.daily_top_features,
    "daily_metrics": mart.daily_metrics_mart,
}


def end_of(day: date) -> datetime:
    return datetime.combine(day, time.max)


def register_lake(spark: SparkSession, paths: dict[str, str], min_year: str | None = None) -> dict[str, DataFrame]:
    """Temporary views over landed tables; ``analytics`` also gives ``flattened_analytics``."""
    pin(spark)
    tables = {name: READERS[name](spark, path) for name, path in paths.items()}
    if "analytics" in tables:
        tables["flattened_analytics"] = flatten_events(tables["analytics"], min_year)
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return tables


def register_daily_metrics(events: DataFrame, as_of: date, **options) -> DataFrame:
    """The ``daily_metrics`` view over product events."""
    metrics = mart.daily_metrics_mart(events, as_of, **options)
    metrics.createOrReplaceTempView("daily_metrics")
    return metrics


def run(name: str, rows: DataFrame, as_of: date, **options) -> DataFrame:
    """A query by its name, over the flattened events or, for ``EVENT_QUERIES``, product events."""
    return (NAMED_QUERIES | EVENT_QUERIES)[name](rows, as_of, **options)
