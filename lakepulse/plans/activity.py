"""How much the app is used: per day, per event type, per screen, per user."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.functions.exprs import epoch_ms, flag, is_event, label, ms_date, percent, ratio, tally
from lakepulse.operators.predicates import in_period, scoped, filled
from lakepulse.operators.rollups import DONE, count_ids, device_days

DAY = ["year", "month", "day"]


def daily_active_users(
    flat: DataFrame, as_of: date, history_months: int = 1, period: Column | None = None
) -> DataFrame:
    """Per day: users, sessions, events, completions and their ratios."""
    compact = (
        flat.where(in_period(as_of, period, history_months))
        .groupBy(*DAY, "device_id", "session_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            tally(is_event(DONE)).alias("completed"),
            tally(is_event("screen_view")).alias("views"),
            tally(is_event("new_focus_selected")).alias("new_focus"),
            tally(is_event("app_background")).alias("backgrounds"),
        )
    )
    daily = compact.groupBy(*DAY).agg(
        count_ids("device_id").alias("daily_active_users"),
        count_ids("session_id").alias("daily_unique_sessions"),
        F.sum("n").alias("total_events"),
        count_ids("session_id", F.col("completed") > 0).alias("sessions_with_anxiety_completion"),
        F.sum("completed").alias("anxiety_completion_events"),
        F.sum("views").alias("screen_views"),
        F.sum("new_focus").alias("new_focus_selections"),
        F.sum("backgrounds").alias("app_backgrounds"),
    )
    return daily.select(
        "*",
        ratio("total_events", "daily_active_users").alias("events_per_user"),
        ratio("daily_unique_sessions", "daily_active_users").alias("sessions_per_user"),
        percent("sessions_with_anxiety_completion", "daily_unique_sessions").alias("session_completion_rate"),
    ).orderBy(*DAY)


def event_type_overview(flat: DataFrame, as_of: date, period: Column | None = None) -> DataFrame:
    """Per event type: volume, reach and share of all events."""
    compact = (
        flat.where(in_period(as_of, period))
        .groupBy("event_type", "device_id", "session_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_type = compact.groupBy("event_type").agg(
        F.sum("n").alias("total_events"),
        count_ids("session_id").alias("unique_sessions"),
        count_ids("device_id").alias("unique_users"),
    )
    everything = F.sum("total_events").over(Window.partitionBy())  # one row per event type
    return by_type.select(
        "*",
        percent("total_events", everything).alias("percentage_of_total_events"),
        ratio("unique_sessions", "unique_users").alias("sessions_per_user"),
    ).orderBy(F.desc("total_events"), "event_type")


def screen_navigation(flat: DataFrame, as_of: date, period: Column | None = None) -> DataFrame:
    """Per screen: views, reach, active days, first and last view."""
    views = flat.where(in_period(as_of, period) & is_event("screen_view") & filled("screen_name"))
    compact = views.groupBy("screen_name", "device_id", "session_id", ms_date(epoch_ms()).alias("active_date")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_timestamp").alias("first_view"),
        F.max("event_timestamp").alias("last_view"),
    )
    by_screen = compact.groupBy("screen_name").agg(
        F.sum("n").alias("total_views"),
        count_ids("device_id").alias("unique_users"),
        count_ids("session_id").alias("unique_sessions"),
        count_ids("active_date").alias("active_days"),
        F.min("first_view").alias("first_view"),
        F.max("last_view").alias("last_view"),
    )
    return by_screen.select(
        "*",
        ratio("total_views", "unique_users").alias("views_per_user"),
        ratio("total_views", "unique_sessions").alias("views_per_session"),
        ratio("unique_sessions", "unique_users").alias("sessions_per_user"),
    ).orderBy(F.desc("total_views"), "screen_name")


def user_engagement(
    flat: DataFrame, as_of: date, min_sessions: int = 1, period: Column | None = None
) -> DataFrame:
    """Per device: sessions, active days, depth of use, and an engagement level.

    The levels cover one completed session and up; a device without any is labelled apart.
    """
    compact = (
        flat.where(in_period(as_of, period))
        .groupBy("device_id", "session_id", ms_date(epoch_ms()).alias("active_date"))
        .agg(F.count(F.lit(1)).alias("n"), tally(is_event(DONE)).alias("completed"))
    )
    users = compact.groupBy("device_id").agg(
        count_ids("session_id").alias("unique_sessions"),
        count_ids("active_date").alias("active_days"),
        F.sum("n").alias("total_events"),
        F.sum("completed").alias("completed_anxiety_sessions"),
    )
    done = F.col("completed_anxiety_sessions")
    return (
        users.where(F.col("unique_sessions") >= min_sessions)
        .select(
            "*",
            ratio("total_events", "unique_sessions").alias("events_per_session"),
            ratio("unique_sessions", "active_days").alias("sessions_per_day"),
            label(
                [(done >= 5, "High Engagement"), (done >= 2, "Medium Engagement"), (done >= 1, "Low Engagement")],
                "No Completed Session",
            ).alias("engagement_level"),
        )
        .orderBy(F.desc("completed_anxiety_sessions"), "device_id")
    )


def dau_alerts(
    flat: DataFrame,
    as_of: date,
    drop_percent: float = 20.0,
    min_completion: float = 25.0,
    min_events: float = 15.0,
    period: Column | None = None,
) -> DataFrame:
    """Daily alert flags over the daily activity table."""
    daily = daily_active_users(flat, as_of, period=period)
    before = F.lag("daily_active_users").over(Window.orderBy(*DAY))  # one row per day
    compared = daily.withColumn("previous_users", before)
    change = percent(F.col("daily_active_users") - F.col("previous_users"), "previous_users")
    flags = compared.select(
        *DAY,
        "daily_active_users",
        "previous_users",
        change.alias("user_change_percent"),
        "session_completion_rate",
        "events_per_user",
        "anxiety_completion_events",
    )
    return flags.select(
        "*",
        flag(F.col("user_change_percent") < -drop_percent).alias("alert_user_drop"),
        flag(F.col("session_completion_rate") < min_completion).alias("alert_low_completion"),
        flag(F.col("events_per_user") < min_events).alias("alert_low_engagement"),
        flag(F.col("anxiety_completion_events") == 0).alias("alert_no_completions"),
    ).orderBy(*DAY)


def new_vs_returning(flat: DataFrame, as_of: date | None = None, period: Column | None = None) -> DataFrame:
    """Per day: users seen for the first time in the rows read (the month of ``as_of``, or ``period``) and users seen before."""
    days = device_days(scoped(flat, as_of, period)).where(F.col("device_id").isNotNull())
    # One row per device and day, so this window is bounded by the days in the lake.
    first = F.min("activity_date").over(Window.partitionBy("device_id"))
    seen = days.withColumn("first_date", first)
    return (
        seen.groupBy("activity_date")
        .agg(
            tally(F.col("first_date") == F.col("activity_date")).alias("new_users"),
            tally(F.col("first_date") < F.col("activity_date")).alias("returning_users"),
        )
        .orderBy("activity_date")
    )
