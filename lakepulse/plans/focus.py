"""What sessions are about and when they happen."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepulse.functions.exprs import (
    epoch_ms,
    is_event,
    iso_weekday,
    label,
    ms_date,
    ms_hour,
    number,
    percent,
    ratio,
    round_half_up,
    tally,
    weekday_name,
)
from lakepulse.operators.predicates import in_period, last_days
from lakepulse.operators.rollups import DONE, count_ids


def _mean(name: str) -> Column:
    """Average rebuilt from partial sums and counts."""
    return ratio(F.sum(f"{name}_sum"), F.sum(f"{name}_n"), digits=None)


def _partial(name: str, value: Column) -> list[Column]:
    return [F.sum(value).alias(f"{name}_sum"), F.count(value).alias(f"{name}_n")]


def focus_sessions(flat: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Per focus area: sessions, users, levels and the mix of responses."""
    keys = ["focus", "specific_focus"]
    done = flat.where(is_event(DONE) & last_days(as_of, days) & F.col("focus").isNotNull())
    compact = done.groupBy(*keys, "session_id", "device_id").agg(
        F.count(F.lit(1)).alias("n"),
        *_partial("danger", number("danger_level")),
        *_partial("probability", number("probability_level")),
        *[tally(F.col("response") == r).alias(r.lower()) for r in ("Maintain", "Reduce", "Increase")],
    )
    areas = compact.groupBy(*keys).agg(
        count_ids("session_id").alias("unique_sessions"),
        count_ids("device_id").alias("unique_users"),
        F.sum("n").alias("total_anxiety_events"),
        _mean("danger").alias("avg_danger_level"),
        _mean("probability").alias("avg_probability_level"),
        F.sum("maintain").alias("maintain_responses"),
        F.sum("reduce").alias("reduce_responses"),
        F.sum("increase").alias("increase_responses"),
    )
    return areas.select(
        "*",
        ratio("unique_sessions", "unique_users").alias("sessions_per_user"),
        percent("reduce_responses", "total_anxiety_events").alias("reduce_response_percentage"),
    ).orderBy(F.desc("unique_sessions"), *keys)


def session_timing(flat: DataFrame, as_of: date, period: Column | None = None) -> DataFrame:
    """Activity and severity by hour of day and by weekday.

    Both breakdowns read one table of (date, hour, session, device) counts.
    """
    ms = epoch_ms()
    done = is_event(DONE)
    danger = F.when(done, number("danger_level"))
    rows = flat.where(in_period(as_of, period) & is_event(DONE, "screen_view", "new_focus_selected"))
    compact = rows.groupBy(
        ms_date(ms).alias("date"), ms_hour(ms).alias("hour"), "session_id", "device_id"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        tally(done).alias("completed"),
        *_partial("danger", danger),
        *_partial("probability", F.when(done, number("probability_level"))),
        tally(danger >= 7).alias("high"),
    )

    def breakdown(title: str, key: Column, dimension: Column, category: Column) -> DataFrame:
        grouped = compact.groupBy(key.alias("key")).agg(
            count_ids("session_id", F.col("completed") > 0).alias("unique_anxiety_sessions"),
            F.sum("completed").alias("anxiety_completion_events"),
            F.sum("n").alias("total_events"),
            count_ids("device_id").alias("unique_users"),
            count_ids("session_id").alias("unique_sessions"),
            round_half_up(_mean("danger"), 2).alias("avg_danger_level"),
            round_half_up(_mean("probability"), 2).alias("avg_probability_level"),
            F.sum("high").alias("high_anxiety_sessions"),
        )
        return grouped.where(F.col("unique_anxiety_sessions") > 0).select(
            F.lit(title).alias("analysis_type"),
            dimension.alias("time_dimension"),
            category.alias("time_category"),
            *[c for c in grouped.columns if c != "key"],
            percent("high_anxiety_sessions", "unique_anxiety_sessions").alias("high_anxiety_percentage"),
            ratio("unique_anxiety_sessions", "unique_users").alias("anxiety_sessions_per_user"),
            "key",
        )

    key = F.col("key")
    period = label(
        [
            (key.between(6, 11), "Morning (6-11am)"),
            (key.between(12, 17), "Afternoon (12-5pm)"),
            (key.between(18, 21), "Evening (6-9pm)"),
            (key.isNotNull(), "Night (10pm-5am)"),
        ]
    )
    hourly = breakdown("Hourly Analysis", F.col("hour"), key.cast("string"), period)
    kind = label([(key <= 5, "Weekday")], "Weekend")
    daily = breakdown("Daily Analysis", iso_weekday("date"), weekday_name(key), kind)
    return hourly.unionByName(daily).orderBy("analysis_type", "key").drop("key")
