"""Three ways to put one engagement score on the app; each is a percentage in one row."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.functions.exprs import HOUR_MS, epoch_ms, flag, is_event, ms_date, percent
from lakepulse.operators.predicates import between_days, scoped
from lakepulse.operators.rollups import count_ids

ACTIONS = ["submitted_feedback", "created_profile", "uploaded_content"]


def _score(counts: DataFrame, part: str, whole: str) -> DataFrame:
    return counts.withColumn("engagement_score", percent(part, whole))


def session_based(flat: DataFrame, at: datetime) -> DataFrame:
    """Sessions active in the hour up to ``at``, against that day's users so far."""
    at = at.replace(tzinfo=timezone.utc)
    now = int(at.timestamp() * 1000)
    ms = epoch_ms()
    day = at.date()
    hour_ago = (at - timedelta(hours=1)).date()
    rows = flat.where(between_days(day - timedelta(days=1), day) & (ms_date(ms) >= F.lit(hour_ago)) & (ms <= now))
    recent, today = ms > now - HOUR_MS, ms_date(ms) == F.lit(day)
    compact = rows.groupBy("device_id", "session_id").agg(
        F.max(flag(recent)).alias("recent"), F.max(flag(today)).alias("today")
    )
    counts = compact.agg(
        count_ids("session_id", F.col("recent") == 1).alias("active_sessions"),
        count_ids("device_id", F.col("today") == 1).alias("daily_active_users"),
    )
    return _score(counts, "active_sessions", "daily_active_users")


def activity_based(
    flat: DataFrame, as_of: date | None = None, actions: list[str] | None = None, period: Column | None = None
) -> DataFrame:
    """Users who took one of the listed actions, against all users."""
    users = (
        scoped(flat, as_of, period)
        .where(F.col("device_id").isNotNull())
        .groupBy("device_id")
        .agg(F.max(flag(is_event(*(actions or ACTIONS)))).alias("engaged"))
    )
    counts = users.agg(
        F.coalesce(F.sum("engaged"), F.lit(0)).alias("engaged_users"), F.count(F.lit(1)).alias("total_users")
    )
    return _score(counts, "engaged_users", "total_users")


def retention_based(
    flat: DataFrame, as_of: date | None = None, days: int = 7, period: Column | None = None
) -> DataFrame:
    """Users seen again within ``days`` days after their first day, against all users."""
    active = (
        scoped(flat, as_of, period)
        .where(F.col("device_id").isNotNull())
        .select("device_id", ms_date(epoch_ms()).alias("date"))
        .distinct()
    )
    first = F.min("date").over(Window.partitionBy("device_id"))  # bounded by the days in the lake
    since = active.withColumn("since", F.datediff("date", first))
    users = since.groupBy("device_id").agg(F.max(flag(F.col("since").between(1, days))).alias("returned"))
    counts = users.agg(
        F.coalesce(F.sum("returned"), F.lit(0)).alias("returning_users"), F.count(F.lit(1)).alias("total_users")
    )
    return _score(counts, "returning_users", "total_users")
