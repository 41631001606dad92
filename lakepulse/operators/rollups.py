"""Small aggregated tables that several analyses start from.

Distinct counts are taken in two levels. The first level groups by the reported key *and* the ids,
where map-side combining collapses a hot device or session to one row per task; the second level
counts distinct ids over that compact table, so the expansion Spark needs for several distinct
counts never touches raw events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepulse.functions.exprs import epoch_ms, flag, is_event, ms_date, number, tally

DONE = "anxiety_session_completed"


def completions(flat: DataFrame) -> DataFrame:
    """Completed sessions with their levels as numbers and their time as epoch milliseconds."""
    return flat.where(is_event(DONE)).select(
        "device_id",
        "session_id",
        "event_id",
        epoch_ms().alias("ms"),
        number("danger_level").alias("danger_level"),
        number("probability_level").alias("probability_level"),
        "response",
        "focus",
        "specific_focus",
    )


def session_table(flat: DataFrame, flags: dict[str, str], **more: Column) -> DataFrame:
    """One row per (session, device); each flag says whether its event type occurred."""
    aggregates = [F.max(flag(is_event(kind))).alias(name) for name, kind in flags.items()]
    return flat.groupBy("session_id", "device_id").agg(*aggregates, *[c.alias(n) for n, c in more.items()])


def device_days(flat: DataFrame) -> DataFrame:
    """One row per device and active day."""
    return flat.groupBy("device_id", ms_date(epoch_ms()).alias("activity_date")).agg(
        F.count(F.lit(1)).alias("events"), tally(is_event(DONE)).alias("completed")
    )


def count_ids(name: str, where: Column | None = None) -> Column:
    return F.count_distinct(F.col(name) if where is None else F.when(where, F.col(name)))


def most_common(value: Column, count: Column) -> Column:
    """Most frequent value from counted values; the lowest value wins ties, NULL never wins."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(-count, value)))
