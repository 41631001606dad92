"""How levels move from one completed session to the next.

No SQL exists for these analyses in what we follow, only descriptions; ``anxiety_trend`` and
``wellness_journey`` have one line each, so their exact columns are our definition. Rows without a
device are left out, as nothing follows them from one session to the next. Each reads the month of
``as_of`` or the given ``period``, and looks no further for the next or the first session.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.functions.exprs import label, ms_date, percent, ratio, round_half_up, tally
from lakepulse.operators.predicates import scoped
from lakepulse.operators.rollups import completions, count_ids
from lakepulse.operators.runs import ordered_runs


def next_session(flat: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Each completed session with the levels of the same device's next one."""
    paired = ordered_runs(
        completions(flat).where(F.col("device_id").isNotNull()),
        ["device_id"],
        "ms",
        ["event_id"],
        lambda w: {
            "next_danger": F.lead("danger_level").over(w),
            "next_probability": F.lead("probability_level").over(w),
        },
        after=1,
        hot_rows=hot_rows,
    )
    return paired.select(
        "*",
        (F.col("next_danger") - F.col("danger_level")).alias("danger_change"),
        (F.col("next_probability") - F.col("probability_level")).alias("probability_change"),
        F.col("run_index").alias("user_session_number"),
    ).drop("run_index", "run_length")


def response_effectiveness(
    flat: DataFrame,
    as_of: date | None = None,
    min_sessions: int = 1,
    period: Column | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Per response and focus: change to the next session, improvement rates, a rating."""
    keys = ["response", "focus"]
    pairs = next_session(scoped(flat, as_of, period), hot_rows).where(F.col("response").isNotNull())
    sums = {
        "initial": F.col("danger_level"),
        "subsequent": F.col("next_danger"),
        "danger": F.col("danger_change"),
        "probability": F.col("probability_change"),
    }
    compact = pairs.groupBy(*keys, "session_id", "device_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"{name}_sum") for name, c in sums.items()],
        *[F.count(c).alias(f"{name}_n") for name, c in sums.items()],
        tally(F.col("danger_change") < 0).alias("danger_better"),
        tally(F.col("probability_change") < 0).alias("probability_better"),
    )
    mean = lambda name: ratio(F.sum(f"{name}_sum"), F.sum(f"{name}_n"), digits=None)
    grouped = compact.groupBy(*keys).agg(
        count_ids("session_id").alias("unique_sessions_with_response"),
        count_ids("device_id").alias("unique_users"),
        F.sum("n").alias("total_response_events"),
        round_half_up(mean("initial"), 2).alias("avg_initial_danger_level"),
        round_half_up(mean("subsequent"), 2).alias("avg_subsequent_danger_level"),
        mean("danger").alias("change"),
        round_half_up(mean("probability"), 2).alias("avg_probability_change"),
        percent(F.sum("danger_better"), F.sum("danger_n")).alias("danger_improvement_rate"),
        percent(F.sum("probability_better"), F.sum("probability_n")).alias("probability_improvement_rate"),
    )
    change = F.col("change")
    rating = label(
        [
            (change < -0.5, "Highly Effective"),
            (change < 0, "Effective"),
            (change == 0, "Neutral"),
            (change > 0, "Concerning"),
        ]
    )
    return (
        grouped.where(F.col("unique_sessions_with_response") >= min_sessions)
        .select(
            "*",
            round_half_up(change, 2).alias("avg_danger_change"),
            rating.alias("response_effectiveness_rating"),
        )
        .drop("change")
        .orderBy(*keys)
    )


def response_trend(
    flat: DataFrame, as_of: date | None = None, period: Column | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Rolling five-session effect of each response for each device."""
    flat = scoped(flat, as_of, period)
    pairs = next_session(flat, hot_rows).select(
        "device_id", "session_id", "event_id", "ms", "response", "danger_change", "user_session_number"
    )
    return ordered_runs(
        pairs,
        ["device_id", "response"],
        "ms",
        ["event_id"],
        lambda w: {"recent_effectiveness_trend": F.avg("danger_change").over(w.rowsBetween(-4, 0))},
        before=4,
        hot_rows=hot_rows,
        sizes=completions(flat).where(F.col("device_id").isNotNull()),
    ).drop("run_index", "run_length")


def anxiety_trend(
    flat: DataFrame, as_of: date | None = None, period: Column | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Per device and completed session: number, level, 3-session average, change since the first."""
    done = completions(scoped(flat, as_of, period)).where(
        F.col("device_id").isNotNull() & F.col("danger_level").isNotNull()
    )
    runs = ordered_runs(
        done,
        ["device_id"],
        "ms",
        ["event_id"],
        lambda w: {"moving_avg_danger": F.avg("danger_level").over(w.rowsBetween(-2, 0))},
        before=2,
        hot_rows=hot_rows,
    )
    first = done.groupBy("device_id").agg(
        F.min_by("danger_level", F.struct("ms", "event_id")).alias("first_danger")
    )
    return runs.join(first, "device_id").select(
        "device_id",
        "session_id",
        "event_id",
        F.col("run_index").alias("session_number"),
        "danger_level",
        round_half_up("moving_avg_danger", 2).alias("moving_avg_danger"),
        (F.col("danger_level") - F.col("first_danger")).alias("change_from_first"),
    )


def wellness_journey(flat: DataFrame, as_of: date | None = None, period: Column | None = None) -> DataFrame:
    """Per device and week (from Monday): sessions, average levels, change against the week before."""
    done = completions(scoped(flat, as_of, period)).where(F.col("device_id").isNotNull())
    day = ms_date("ms")
    week = F.date_sub(day, F.weekday(day))
    levels = {"danger": "danger_level", "probability": "probability_level"}
    compact = done.groupBy("device_id", week.alias("week_start"), "session_id").agg(
        *[F.sum(c).alias(f"{n}_sum") for n, c in levels.items()],
        *[F.count(c).alias(f"{n}_n") for n, c in levels.items()],
    )
    weeks = compact.groupBy("device_id", "week_start").agg(
        F.count("session_id").alias("sessions"),
        *[ratio(F.sum(f"{n}_sum"), F.sum(f"{n}_n")).alias(f"avg_{n}") for n in levels],
    )
    w = Window.partitionBy("device_id").orderBy("week_start")  # bounded by the weeks in the lake
    return weeks.select(
        "*",
        (F.col("sessions") - F.lag("sessions").over(w)).alias("sessions_change"),
        round_half_up(F.col("avg_danger") - F.lag("avg_danger").over(w), 2).alias("danger_change"),
    )
