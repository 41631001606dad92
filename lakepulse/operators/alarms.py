"""Tumbling-window series and alarm states.

A series is first aggregated to one row per window (map-side combined); only that table, whose size
depends on the time span and not on the data, meets an ordered window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COMPARISONS = {
    ">": lambda v, t: v > t,
    ">=": lambda v, t: v >= t,
    "<": lambda v, t: v < t,
    "<=": lambda v, t: v <= t,
}
MISSING = ("missing", "notBreaching", "breaching", "ignore")
#: Empty windows in a row that are filled in; ten years of minutes. More is taken for a wrong time and is an error.
MAX_GAP = 5_256_000


def window_start(ms: str, period_s: int) -> Column:
    return (F.floor(F.col(ms) / (period_s * 1000)) * (period_s * 1000)).cast("bigint")


def window_series(df: DataFrame, ms: str, period_s: int, by: list[str], **aggregates: Column) -> DataFrame:
    """One row per non-empty window (and ``by`` key); rows without a time belong to no window."""
    timed = df.where(F.col(ms).isNotNull())
    return timed.groupBy(*by, window_start(ms, period_s).alias("window_start")).agg(
        *[c.alias(name) for name, c in aggregates.items()]
    )


def fill_windows(series: DataFrame, period_s: int, by: list[str]) -> DataFrame:
    """Add the windows between the first and the last that hold no data.

    Each window spreads over the gap up to the next one, so the series is read once and not joined.
    """
    step = F.lit(period_s * 1000).cast("bigint")
    following = F.lead("window_start").over(Window.partitionBy(*by).orderBy("window_start"))
    values = [c for c in series.columns if c not in (*by, "window_start")]
    last = F.coalesce(F.col("following") - step, F.col("window_start"))
    wide = (last - F.col("window_start")) / step > MAX_GAP
    wrong = F.raise_error(F.concat(F.lit("too many empty windows behind "), F.col("window_start").cast("string")))
    last = F.when(wide, wrong.cast("bigint")).otherwise(last)
    spread = series.withColumn("following", following).select(
        *by, F.col("window_start").alias("at"), *values, F.explode(F.sequence("window_start", last, step)).alias("window_start")
    )
    own = F.col("window_start") == F.col("at")
    return spread.select(*by, "window_start", *[F.when(own, F.col(c)).alias(c) for c in values])


def alarm_states(
    series: DataFrame,
    period_s: int,
    comparison: str,
    threshold: float | Column,
    n_periods: int,
    missing: str = "missing",
    by: list[str] | None = None,
) -> DataFrame:
    """ALARM where the last ``n_periods`` windows all breach.

    ``series`` has ``window_start`` and ``value``. A window without data breaches or not as
    ``missing`` says: ``breaching``, ``notBreaching``; ``missing`` gives INSUFFICIENT_DATA once all
    ``n_periods`` lack data; ``ignore`` keeps the state from before.
    """
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    by = by or []
    value = F.col("value")
    breach = F.when(value.isNotNull(), COMPARISONS[comparison](value, threshold).cast("int"))
    if missing in ("notBreaching", "breaching"):
        breach = F.coalesce(breach, F.lit(int(missing == "breaching")))
    filled = fill_windows(series, period_s, by).withColumn("breach", breach)

    run = Window.partitionBy(*by).orderBy("window_start")
    recent = run.rowsBetween(-(n_periods - 1), 0)
    breaching, known = F.sum("breach").over(recent), F.count("breach").over(recent)
    state = F.when(breaching == n_periods, "ALARM")
    if missing == "ignore":
        filled = filled.withColumn("known_state", state.when(F.col("breach").isNotNull(), "OK"))
        state = F.coalesce(F.last("known_state", ignorenulls=True).over(run), F.lit("INSUFFICIENT_DATA"))
    elif missing == "missing":
        state = state.when(known == 0, "INSUFFICIENT_DATA").otherwise("OK")
    else:
        state = state.otherwise("OK")
    return filled.select(*by, "window_start", "value", "breach", state.alias("state"))
