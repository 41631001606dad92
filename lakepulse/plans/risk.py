"""Risk review report: devices whose recent sessions call for a look by qualified people.

The report lists devices only; it triggers nothing by itself.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepulse.functions.exprs import label, ms_date, rank_of, tally
from lakepulse.operators.predicates import contains_any, in_period
from lakepulse.operators.rollups import completions
from lakepulse.operators.runs import latest, ordered_runs

LEVELS = ["CRITICAL", "HIGH", "MODERATE"]
CRISIS_WORDS = ["crisis", "emergency", "harm"]

# Fixed values: (threshold, points) per scored indicator, highest threshold first.
POINTS = {
    "latest_danger_level": [(9, 4), (8, 3), (7, 2), (6, 1)],
    "recent_avg_danger": [(8, 3), (7, 2), (6, 1)],
    "very_recent_high_danger": [(2, 3), (1, 2)],
    "extreme_danger_sessions": [(3, 2), (1, 1)],
    "concerning_increase_responses": [(2, 2), (1, 1)],
    "crisis_focus_sessions": [(1, 3)],
}


def _points(name: str) -> Column:
    score = None
    for threshold, points in POINTS[name]:
        hit = F.col(name) >= threshold
        score = F.when(hit, points) if score is None else score.when(hit, points)
    return score.otherwise(0)


def _any(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _assessed(flat: DataFrame, as_of: date, period: Column | None) -> DataFrame:
    return completions(flat.where(in_period(as_of, period))).dropna(subset=["danger_level", "probability_level"])


def risk_signals(
    flat: DataFrame, as_of: date, hot_rows: int | None = None, period: Column | None = None
) -> DataFrame:
    """Each completed session with its recency, the device's session count and its trailing levels."""
    done = _assessed(flat, as_of, period)
    danger = F.col("danger_level")
    runs = ordered_runs(
        done,
        ["device_id"],
        "ms",
        ["event_id"],
        lambda w: {
            "recent_avg_danger": F.avg(danger).over(w.rowsBetween(-2, 0)),
            "recent_max_danger": F.max(danger).over(w.rowsBetween(-6, 0)),
        },
        before=6,
        hot_rows=hot_rows,
    )
    return runs.select(
        *done.columns,
        "recent_avg_danger",
        "recent_max_danger",
        (F.col("run_length") - F.col("run_index") + 1).alias("recency_rank"),
        F.col("run_length").alias("total_sessions"),
    )


def risk_indicators(flat: DataFrame, as_of: date, period: Column | None = None) -> DataFrame:
    """Per device: whole-period counts, and indicators over its last seven completed sessions.

    The trailing frames are only ever read at the newest session, so the seven newest rows per
    device are enough; they are cut before the shuffle. The counts combine on the map side.
    """
    done = _assessed(flat, as_of, period)
    danger = F.col("danger_level")
    totals = done.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        tally(danger >= 8).alias("high_danger_sessions"),
        tally(danger >= 9).alias("extreme_danger_sessions"),
        tally((F.col("response") == "Increase") & (danger >= 7)).alias("concerning_increase_responses"),
        tally(contains_any("focus", CRISIS_WORDS)).alias("crisis_focus_sessions"),
    )
    recency = F.col("recency")
    newest = latest(done, ["device_id"], "ms", ["event_id"], 7)
    focus_counts = F.array_agg(F.when(recency <= 5, F.col("focus")))  # at most five values
    recent = newest.groupBy("device_id").agg(
        F.max(F.when(recency == 1, danger)).alias("latest_danger_level"),
        F.max(F.when(recency == 1, F.col("probability_level"))).alias("latest_probability_level"),
        F.max(F.when(recency == 1, ms_date("ms"))).alias("last_session_date"),
        F.avg(F.when(recency <= 3, danger)).alias("recent_avg_danger"),
        F.max(danger).alias("recent_max_danger"),
        tally((recency <= 7) & (danger >= 7)).alias("recent_concerning_sessions"),
        tally((recency <= 3) & (danger >= 8)).alias("very_recent_high_danger"),
        tally(recency <= 5).alias("recent_session_count"),
        focus_counts.alias("recent_focus"),
    )
    joined = totals.withColumnRenamed("device_id", "d").join(recent, F.col("d").eqNullSafe(F.col("device_id")))
    return joined.drop("d")


def _mode_of(values: str) -> Column:
    """Most frequent element of a short array; the lowest wins ties."""
    counted = F.transform(
        F.array_distinct(values),
        lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), v.alias("v")),
    )
    return F.array_min(counted)["v"]


def crisis_intervention(
    flat: DataFrame, as_of: date, min_sessions: int = 2, period: Column | None = None
) -> DataFrame:
    """Devices at elevated risk with an additive score, a level and a recommendation."""
    indicators = risk_indicators(flat, as_of, period).where(F.col("total_sessions") >= min_sessions)
    score = sum((_points(name) for name in POINTS), F.lit(0))
    latest_level, average = F.col("latest_danger_level"), F.col("recent_avg_danger")
    high, extreme = F.col("high_danger_sessions"), F.col("extreme_danger_sessions")
    level = label(
        [
            (
                _any(
                    latest_level >= 9,
                    F.col("very_recent_high_danger") >= 2,
                    F.col("crisis_focus_sessions") > 0,
                ),
                "CRITICAL",
            ),
            (_any(latest_level >= 8, average >= 8, extreme >= 2), "HIGH"),
            (_any(latest_level >= 7, average >= 7, high >= 5), "MODERATE"),
            (_any(latest_level >= 6, high >= 3), "ELEVATED"),
        ],
        "LOW",
    )
    assessed = indicators.select(
        "*",
        F.datediff(F.lit(as_of), "last_session_date").alias("days_since_last_session"),
        score.alias("risk_score"),
        level.alias("risk_level"),
        _mode_of("recent_focus").alias("recent_primary_focus"),
    )
    days, risk = F.col("days_since_last_session"), F.col("risk_level")
    listed = assessed.where(risk.isin(LEVELS) | ((risk == "ELEVATED") & (days <= 1)))
    recency = label(
        [
            (days == 0, "Active Today"),
            (days <= 1, "Recent Activity"),
            (days <= 3, "Moderately Recent"),
            (days <= 7, "Week Ago"),
        ],
        "Inactive >7 days",
    )
    advice = label(
        [
            ((risk == "CRITICAL") & (days <= 1), "IMMEDIATE ATTENTION NEEDED"),
            ((risk == "HIGH") & (days <= 2), "Priority Follow-up"),
            ((risk == "MODERATE") & (days <= 3), "Check-in Recommended"),
        ],
        "Monitor",
    )
    return listed.select(
        "device_id", "risk_level", "risk_score", "latest_danger_level", "latest_probability_level",
        "recent_avg_danger", "recent_max_danger", "last_session_date", "days_since_last_session", "total_sessions",
        "high_danger_sessions", "extreme_danger_sessions", "very_recent_high_danger",
        "concerning_increase_responses", "crisis_focus_sessions", "recent_primary_focus",
        recency.alias("activity_recency"),
        advice.alias("intervention_recommendation"),
    ).orderBy(rank_of("risk_level", LEVELS), "days_since_last_session", F.desc("risk_score"), "device_id")
