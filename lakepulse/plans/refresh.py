"""Incremental maintenance of the daily metrics mart: only days that new files can change are computed again."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepulse.plans.mart import DAY, HORIZONS, facts_of, metrics_of, percentiles_of, recent, write_mart
from lakepulse.session import written


def _shifted(days: Iterable[date], offsets: list[int]) -> set[date]:
    return {d + timedelta(days=k) for d in days for k in offsets}


def stale_days(changed: Iterable[date], slack_days: int = 1) -> set[date]:
    """The mart's days that change with the events in these directories.

    A directory changes its own day, and the retention of first opens that it may hold the returns of: those ``h`` to
    ``h + 1`` days earlier for each horizon, and ``slack_days`` on either side, as an event may lie that many directories
    before its own day.
    """
    days = set(changed)
    return days | _shifted(days, [k - h for h in HORIZONS for k in range(-1 - slack_days, slack_days + 1)])


def needed_days(stale: Iterable[date], slack_days: int = 1) -> set[date]:
    """The directories that the mart's rows of these days are made from."""
    days = set(stale)
    return days | _shifted(days, [h + k for h in HORIZONS for k in range(-slack_days, slack_days + 2)])


def in_days(days: Iterable[date]) -> Column:
    """A filter on directories."""
    own = F.make_date(*[F.col(c).cast("int") for c in DAY])
    return own.isin(sorted(days)) if days else F.lit(False)


def changed_days(changes: DataFrame) -> set[date]:
    """The days of ``partition_changes``; as many rows come to the driver as days changed."""
    rows = changes.select(F.make_date(*[F.col(c).cast("int") for c in DAY]).alias("d")).where("d IS NOT NULL").distinct()
    return {r["d"] for r in rows.collect()}


def refresh_mart(
    events: DataFrame,
    path: str,
    changed: Iterable[date],
    as_of: date,
    days: int = 90,
    min_year: str | None = None,
    slack_days: int = 1,
) -> list[date]:
    """Bring the mart at ``path`` up to date with the directories that changed, and return the days written anew.

    The result is that of a full rebuild. Only directories that those days need are read. A day that has no events any
    more is deleted.
    """
    stale = stale_days(changed, slack_days)
    if not stale:
        return []
    spark = events.sparkSession
    needed = events.where(in_days(needed_days(stale, slack_days)))
    rows = written(recent(needed, as_of, days, min_year), "mart-events")
    write_mart(metrics_of(facts_of(rows), percentiles_of(rows.where(in_days(stale))), in_days(stale)), path)
    own = rows.where(in_days(stale)).select(F.make_date(*[F.col(c).cast("int") for c in DAY]).alias("d")).distinct()
    present = {r["d"] for r in own.collect()}
    for gone in sorted(stale - present):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/year={gone:%Y}/month={gone:%m}/day={gone:%d}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return sorted(present)
