"""Analyses over the session table: engagement, treatment steps, the funnel, the anxiety flow."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.functions.exprs import flag, is_event, percent, rank_of, round_half_up, tally
from lakepulse.operators.predicates import in_period
from lakepulse.operators.rollups import DONE, count_ids, session_table
from lakepulse.session import written

TREATMENT_STEPS = {
    "be_cool": "be_cool_step_completed",
    "believe": "believe_step_completed",
    "behave": "behave_step_completed",
    "completed": DONE,
}
FLOW_STEPS = {
    "new_focus": "new_focus_selected",
    "specific_focus": "specific_focus_selected",
    "danger": "danger_level_selected",
    "probability": "probability_level_selected",
    "responded": "response_selected",
    "completed": DONE,
}
FUNNEL_STAGES = ["App Install", "First Anxiety Created", "First Session Completed"]


def session_engagement(flat: DataFrame, as_of: date, period: Column | None = None) -> DataFrame:
    """One summary row over all sessions of the period."""
    sessions = session_table(
        flat.where(in_period(as_of, period) & F.col("session_id").isNotNull()),
        {"completed": DONE, "created": "new_anxiety_created"},
        events=F.count(F.lit(1)),
        views=tally(is_event("screen_view")),
        screens=count_ids("screen_name"),
        switches=tally(is_event("app_background", "app_foreground")),
    )
    total = F.count(F.lit(1))
    return sessions.agg(
        F.lit("Session Engagement Summary").alias("metric_type"),
        count_ids("session_id").alias("total_sessions"),
        count_ids("device_id").alias("total_users"),
        round_half_up(F.avg("events"), 1).alias("avg_events_per_session"),
        round_half_up(F.avg("views"), 1).alias("avg_screen_views_per_session"),
        round_half_up(F.avg("screens"), 1).alias("avg_unique_screens_per_session"),
        percent(F.sum("completed"), total).alias("session_completion_rate_percent"),
        percent(F.sum("created"), total).alias("new_anxiety_creation_rate_percent"),
        round_half_up(F.avg("switches"), 1).alias("avg_app_switches_per_session"),
    )


def treatment_completion(flat: DataFrame, as_of: date, period: Column | None = None) -> DataFrame:
    """Completion rates of the three treatment steps."""
    steps = flat.where(in_period(as_of, period) & is_event(*TREATMENT_STEPS.values()))
    sessions = session_table(steps, TREATMENT_STEPS)
    first_two = (F.col("be_cool") == 1) & (F.col("believe") == 1)
    total = count_ids("session_id")
    rates = {
        "be_cool_completion_rate_percent": F.sum("be_cool"),
        "believe_completion_rate_percent": F.sum("believe"),
        "behave_completion_rate_percent": F.sum("behave"),
        "full_session_completion_rate_percent": F.sum("completed"),
        "first_two_steps_completion_rate_percent": F.sum(flag(first_two)),
        "all_three_steps_completion_rate_percent": F.sum(flag(first_two & (F.col("behave") == 1))),
    }
    return sessions.agg(
        F.lit("Treatment Step Analysis").alias("metric_type"),
        total.alias("total_sessions"),
        count_ids("device_id").alias("total_users"),
        *[percent(done, total).alias(name) for name, done in rates.items()],
    )


def user_journey_funnel(flat: DataFrame, as_of: date, period: Column | None = None) -> DataFrame:
    """Users per onboarding stage and conversion from the stage before.

    Only the three stage events are read; a lake without them reports zero users.
    """
    kinds = {"installed": "app_install", "created": "new_anxiety_created", "completed": DONE}
    stages = flat.where(in_period(as_of, period) & is_event(*kinds.values()))
    users = stages.groupBy("device_id").agg(*[F.max(flag(is_event(k))).alias(n) for n, k in kinds.items()])
    totals = users.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in kinds])
    a, b, c = FUNNEL_STAGES
    rows = totals.selectExpr(
        f"stack(3, '{a}', installed, installed, '{b}', created, installed, '{c}', completed, created) "
        "as (stage, users, previous_stage_users)"
    )
    rate = F.when(F.col("stage") == a, 100.0).otherwise(percent("users", "previous_stage_users"))
    return rows.withColumn("conversion_rate", rate).orderBy(rank_of("stage", FUNNEL_STAGES))


def flow_sessions(flat: DataFrame, as_of: date, period: Column | None = None) -> DataFrame:
    """Sessions of the anxiety flow with the steps taken and the values chosen."""
    steps = flat.where(in_period(as_of, period) & is_event(*FLOW_STEPS.values()))
    return session_table(
        steps,
        FLOW_STEPS,
        final_response=F.max(F.when(is_event("response_selected"), F.col("response"))),
        danger_assessment=F.max(F.when(is_event("danger_level_selected"), F.col("danger_level"))),
        probability_assessment=F.max(F.when(is_event("probability_level_selected"), F.col("probability_level"))),
    )


def response_patterns(sessions: DataFrame) -> DataFrame:
    """How often each response follows an assessment, as a share of that assessment."""
    keys = ["danger_assessment", "probability_assessment", "final_response"]
    counted = sessions.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("response_count"))
    same = Window.partitionBy(*keys[:2])  # a handful of assessment levels
    return counted.withColumn(
        "response_percentage", percent("response_count", F.sum("response_count").over(same), digits=None)
    )


def anxiety_flow_effectiveness(
    flat: DataFrame, as_of: date, min_count: int = 5, period: Column | None = None
) -> DataFrame:
    """Rates of the whole flow, then one row per response pattern.

    Pattern rows carry their count in ``total_anxiety_sessions`` and their share in
    ``focus_selection_rate_percent``; their other columns are empty. Events are read once: both parts
    start from the sessions, which are written.
    """
    sessions = written(flow_sessions(flat, as_of, period), "flow-sessions")
    complete = (
        (F.col("danger") == 1) & (F.col("probability") == 1) & (F.col("responded") == 1) & (F.col("completed") == 1)
    )
    high = ["High", "Very High"]
    total = count_ids("session_id")
    rates = {
        "focus_selection_rate_percent": (F.sum(F.col("new_focus") + F.col("specific_focus")), total),
        "danger_assessment_rate_percent": (F.sum("danger"), total),
        "probability_assessment_rate_percent": (F.sum("probability"), total),
        "response_selection_rate_percent": (F.sum("responded"), total),
        "session_completion_rate_percent": (F.sum("completed"), total),
        "complete_flow_rate_percent": (F.sum(flag(complete)), total),
        "reduce_response_rate_percent": (F.sum(flag(F.col("final_response") == "Reduce")), F.sum("responded")),
        "high_danger_rate_percent": (F.sum(flag(F.col("danger_assessment").isin(high))), F.sum("danger")),
        "high_probability_rate_percent": (
            F.sum(flag(F.col("probability_assessment").isin(high))),
            F.sum("probability"),
        ),
    }
    overall = sessions.agg(
        F.lit("Anxiety Flow Effectiveness").alias("metric_type"),
        total.alias("total_anxiety_sessions"),
        count_ids("device_id").alias("total_users"),
        *[percent(part, whole).alias(name) for name, (part, whole) in rates.items()],
    )
    name = F.concat(
        F.lit("Response Pattern: "), "danger_assessment", F.lit(" danger, "), "probability_assessment",
        F.lit(" prob → "), "final_response",
    )
    patterns = (
        response_patterns(sessions)
        .where(F.col("response_count") >= min_count)
        .select(
            name.alias("metric_type"),
            F.col("response_count").alias("total_anxiety_sessions"),
            round_half_up("response_percentage", 1).alias("focus_selection_rate_percent"),
        )
    )
    return overall.unionByName(patterns, allowMissingColumns=True).orderBy("metric_type")
