"""Nested batches to one row per event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Output columns in order; a renamed one is given as (field, name).
BATCH_COLUMNS = ["batch_id", "batch_timestamp"]
OWNER_COLUMNS = [
    "user_id", "device_id", "session_id", "app_version", "os_version", "device_model", "platform", "timezone",
    "network_type",
]
EVENT_COLUMNS = [
    "event_id", ("timestamp", "event_timestamp"), "event_type", "event_name", "screen_name", "action", "category",
    "label", "value", "duration",
    "focus_session.session_type", ("focus_session.duration_seconds", "focus_duration"),
    "focus_session.completion_rate", "focus_session.technique_used", "focus_session.difficulty_level",
    "focus_session.mood_before", "focus_session.mood_after", "focus_session.interruptions",
    "breathing_exercise.exercise_type", "breathing_exercise.breaths_per_minute", "breathing_exercise.total_breaths",
    ("breathing_exercise.session_duration", "breathing_duration"), "breathing_exercise.pattern_type",
    "breathing_exercise.guide_used", "breathing_exercise.completion_status",
    "danger_probability.danger_level", "danger_probability.probability_level",
    ("danger_probability.context", "danger_context"), "danger_probability.user_confidence",
    "danger_probability.technique_applied", "danger_probability.outcome_rating",
    "user_interaction.interaction_type", "user_interaction.element_id",
    ("user_interaction.position.x", "click_x"), ("user_interaction.position.y", "click_y"),
    "user_interaction.gesture", "user_interaction.response_time_ms",
    "response", "focus", "specific_focus",
]
PARTITION_COLUMNS = ["year", "month", "day", "hour"]


def flatten_events(batches: DataFrame, min_year: str | None = None) -> DataFrame:
    """Unnest ``events``; a batch with an empty or missing array yields nothing.

    A pure projection over a generator: no shuffle, and columns a caller does not use are pruned.
    """
    rows = batches if min_year is None else batches.where(F.col("year") >= min_year)
    parts = [c for c in PARTITION_COLUMNS if c in batches.columns]
    exploded = rows.select(*BATCH_COLUMNS, "batch_metadata", F.explode("events").alias("event"), *parts)
    fields = [(f, f.rsplit(".", 1)[-1]) if isinstance(f, str) else f for f in EVENT_COLUMNS]
    return exploded.select(
        *BATCH_COLUMNS,
        *[F.col(f"batch_metadata.{c}") for c in OWNER_COLUMNS],
        *[F.col(f"event.{field}").alias(name) for field, name in fields],
        *parts,
    )


def to_flat(flattened: DataFrame) -> DataFrame:
    """The column contract of the analyses: time as text, as the view delivers it."""
    return flattened.select(
        "event_id", "device_id", "session_id", "event_type",
        F.col("event_timestamp").cast("string").alias("event_timestamp"),
        "screen_name", "danger_level", "probability_level", "response", "focus", "specific_focus", "duration",
        "year", "month", "day",
    )
