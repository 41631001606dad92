"""Column expressions shared by every analysis.

All of them are built-in expressions, so they stay inside whole-stage codegen. Division by zero
gives NULL, rounding is half up on doubles, and dates are computed in UTC from epoch milliseconds.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 86_400_000
#: Whole numbers that a sum over any number of rows fits in.
WIDE = "decimal(38,0)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: Column | str, digits: int) -> Column:
    """``floor`` gives 64 bits; doubles that these can't hold are whole, and stay as they are."""
    scale = float(10**digits)
    shifted = col(c) * scale + 0.5
    return F.when(F.abs(shifted) < 2.0**63, F.floor(shifted).cast("double")).otherwise(shifted) / scale


def ratio(part: Column | str, whole: Column | str, digits: int | None = 2, scale: float = 1.0) -> Column:
    """``part * scale / whole`` in double arithmetic; NULL when ``whole`` is 0."""
    value = col(part).cast("double") * scale / F.nullif(col(whole).cast("double"), F.lit(0.0))
    return value if digits is None else round_half_up(value, digits)


def micros(c: Column | str) -> Column:
    """A double in whole millionths: sums of them don't depend on the order of the rows.

    A sum beyond 9.2e12 is an error in 64 bits; cast to ``WIDE`` before summing over very many rows.
    """
    return F.floor(col(c) * 1e6 + 0.5)


def mean_of_micros(total: Column | str, n: Column | str) -> Column:
    """The mean from a sum of ``micros`` and the number of values; NULL without any."""
    return ratio(total, n, digits=None) / 1e6


def exact_mean(c: Column | str) -> Column:
    """Aggregate: the mean of a double, the same for any order and partitioning of the rows."""
    return mean_of_micros(F.sum(micros(c).cast(WIDE)), F.count(col(c)))


def percent(part: Column | str, whole: Column | str, digits: int | None = 2) -> Column:
    return ratio(part, whole, digits, 100.0)


def number(c: Column | str) -> Column:
    """Text to double; text that is no number gives NULL."""
    return col(c).try_cast("double")


def epoch_ms(c: Column | str = "event_timestamp") -> Column:
    return col(c).try_cast("bigint")


def ms_date(ms: Column | str) -> Column:
    return F.date_from_unix_date(F.floor(col(ms) / DAY_MS).cast("int"))


def ms_hour(ms: Column | str) -> Column:
    return F.pmod(F.floor(col(ms) / HOUR_MS), F.lit(24)).cast("int")


def ms_timestamp(ms: Column | str) -> Column:
    return F.timestamp_millis(col(ms).cast("bigint"))


def iso_weekday(d: Column | str) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(col(d)) + 1


def weekday_name(dow: Column) -> Column:
    names = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), dow.cast("int"))


def is_event(*event_types: str) -> Column:
    c = F.col("event_type")
    return c == event_types[0] if len(event_types) == 1 else c.isin(*event_types)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or NULL."""
    return F.when(condition, 1).otherwise(0)


def tally(condition: Column) -> Column:
    return F.count_if(condition)


def label(cases: list[tuple[Column, str]], default: str | None = None) -> Column:
    """First matching label; NULL conditions do not match."""
    out = None
    for condition, text in cases:
        out = F.when(condition, text) if out is None else out.when(condition, text)
    return out.otherwise(F.lit(default))


def rank_of(c: Column | str, order: list[str]) -> Column:
    """Position of a label in a fixed order, for sorting; unknown labels come last."""
    out = None
    for i, text in enumerate(order):
        out = F.when(col(c) == text, i) if out is None else out.when(col(c) == text, i)
    return out.otherwise(len(order))


def month_start(as_of: date, months_back: int = 0) -> date:
    index = as_of.year * 12 + as_of.month - 1 - months_back
    return date(index // 12, index % 12 + 1, 1)


def to_ms(day: date) -> int:
    return (day - date(1970, 1, 1)) // timedelta(days=1) * DAY_MS
