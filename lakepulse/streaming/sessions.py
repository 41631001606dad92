"""Sessions by gaps, for rows that carry no session id, on a stream or a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepulse.functions.exprs import HOUR_MS


def gap_sessions(
    rows: DataFrame, by: list[str], ms: str = "ms", gap_ms: int = 1_800_000, delay: str = "10 minutes", **aggregates: Column
) -> DataFrame:
    """``*by, start_ms, last_ms, events`` and ``aggregates`` of sessions: rows of a key follow each other within ``gap_ms``.

    On a stream a session is given once it is closed: the watermark, the newest row of any key less ``delay``, is ``gap_ms``
    past its last row. Rows that are not later than the watermark merge sessions that stood apart until then, in
    whatever order they come. The state holds the aggregates of open sessions, not their rows; each task merges its own
    rows first, so a hot key is small before the shuffle. Rows without a key or a time are left out. A stream writes
    in append mode.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    present = F.col(ms).isNotNull()
    for c in by:
        present &= F.col(c).isNotNull()
    timed = rows.where(present).withColumn("at", F.timestamp_millis(F.col(ms)))
    if rows.isStreaming:
        timed = timed.withWatermark("at", delay)
    session = F.session_window("at", f"{gap_ms} milliseconds").alias("session")
    grouped = timed.groupBy(*by, session).agg(
        F.min(ms).alias("start_ms"), F.max(ms).alias("last_ms"), F.count(F.lit(1)).alias("events"),
        *[c.alias(name) for name, c in aggregates.items()],
    )
    return grouped.drop("session")


def active_sessions(
    sessions: DataFrame, by: list[str] | None = None, every_ms: int = HOUR_MS, within_ms: int = HOUR_MS, gap_ms: int = 1_800_000
) -> DataFrame:
    """``*by, at_ms, active_sessions``: how many sessions have a row in the ``within_ms`` up to each full ``every_ms``.

    Starts and ends suffice while the gap isn't longer than ``within_ms``: a session that began before a moment and ends
    after it has a row less than a gap before it. Moments that no session is active at have no row.
    """
    if gap_ms > within_ms:
        raise ValueError("the gap must not be longer than the time looked back")
    step = F.lit(every_ms)
    first = F.ceil(F.col("start_ms") / step) * step
    last = F.ceil((F.col("last_ms") + within_ms) / step) * step - step
    moments = sessions.where(first <= last).select(*(by or []), F.explode(F.sequence(first, last, step)).alias("at_ms"))
    return moments.groupBy(*(by or []), "at_ms").agg(F.count(F.lit(1)).alias("active_sessions"))
