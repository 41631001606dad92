"""Row filters. Those on year, month and day prune directories before any file is opened."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepulse.functions.exprs import DAY_MS, epoch_ms, iso_weekday, month_start, ms_date, ms_hour, to_ms


def current_period(as_of: date, history_months: int = 1) -> Column:
    """The calendar month of ``as_of``, with earlier months when asked for."""
    months = [month_start(as_of, back) for back in range(history_months)]
    return reduce(or_, [(F.col("year") == f"{m:%Y}") & (F.col("month") == f"{m:%m}") for m in months])


def in_period(as_of: date, period: Column | None = None, history_months: int = 1) -> Column:
    """The caller's own period, such as ``between_days``, or else the month of ``as_of``."""
    return current_period(as_of, history_months) if period is None else period


def scoped(flat: DataFrame, as_of: date | None, period: Column | None) -> DataFrame:
    """Rows of the caller's period or of the month of ``as_of``; all rows only when neither is given."""
    return flat if as_of is None and period is None else flat.where(in_period(as_of, period))


def between_days(start: date, end: date) -> Column:
    """Partition filter for ``start``..``end``: per month, with day bounds at the two ends only."""
    if end < start:
        return F.lit(False)
    terms, month = [], month_start(start)
    while month <= end:
        following = month_start(month, -1)
        parts = [F.col("year") == f"{month:%Y}", F.col("month") == f"{month:%m}"]
        if start > month:
            parts.append(F.col("day") >= f"{start:%d}")
        if end < following - timedelta(days=1):
            parts.append(F.col("day") <= f"{end:%d}")
        terms.append(reduce(and_, parts))
        month = following
    return reduce(or_, terms)


def landed_since(day: date) -> Column:
    """Directories from a day on."""
    year, month = F.col("year"), F.col("month")
    return (
        (year > f"{day:%Y}")
        | ((year == f"{day:%Y}") & (month > f"{day:%m}"))
        | ((year == f"{day:%Y}") & (month == f"{day:%m}") & (F.col("day") >= f"{day:%d}"))
    )


def last_days(as_of: date, days: int, slack_days: int | None = 1) -> Column:
    """Event date in the last ``days`` days, plus the partition filter this implies.

    An event can sit in a directory of a day before its own (a batch that runs over midnight). Directories are read from
    ``slack_days`` days before the first; an event that lies in one further back is not found. None reads all
    directories. There is no upper bound, as in the source rule.
    """
    first = as_of - timedelta(days=days)
    wanted = ms_date(epoch_ms()) >= F.lit(first)
    return wanted if slack_days is None else landed_since(first - timedelta(days=slack_days)) & wanted


def since_ms(
    as_of: date, days: int = 90, ms: str = "ts_ms", min_year: str | None = None, slack_days: int | None = 1
) -> Column:
    """Epoch milliseconds within ``days`` of ``as_of``, as a literal bound, plus the partition filter this implies.

    ``slack_days`` as in ``last_days``.
    """
    bound = F.col(ms) >= F.lit(to_ms(as_of) - days * DAY_MS)
    if slack_days is not None:
        bound = landed_since(as_of - timedelta(days=days + slack_days)) & bound
    return bound if min_year is None else (F.col("year") >= min_year) & bound


def contains_any(column: str, words: list[str]) -> Column:
    """Case-sensitive substring test; NULL text matches nothing."""
    hit = reduce(or_, [F.col(column).contains(w) for w in words])
    return F.coalesce(hit, F.lit(False))


def filled(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def in_time_slice(name: str, ms: Column | None = None) -> Column:
    """Named slices of the week: peak hours, weekend, business hours."""
    ms = epoch_ms() if ms is None else ms
    hour, dow = ms_hour(ms), iso_weekday(ms_date(ms))
    slices = {
        "peak": hour.between(18, 21),
        "weekend": dow >= 6,
        "business": hour.between(9, 17) & (dow <= 5),
    }
    return slices[name]
