"""Retention and churn: device lifecycle, risk of leaving, and cohorts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.functions.exprs import exact_mean, flag, label, percent, rank_of, round_half_up, tally
from lakepulse.operators.predicates import in_period
from lakepulse.operators.rollups import device_days

STAGES = ["New User (0-7 days)", "Establishing User (8-30 days)", "Regular User (31-90 days)", "Long-term User (90+ days)"]
CHURN_LEVELS = ["High Risk", "Medium Risk", "Low Risk", "Active"]


def user_lifecycle(
    flat: DataFrame, as_of: date, history_months: int = 1, period: Column | None = None
) -> DataFrame:
    """Per device: activity span, engagement level, churn risk and a 0-100 retention score.

    ``days_since_first_use`` spans first to last activity. With one month of history, stages
    beyond 30 days cannot occur; ask for more months to see them.
    """
    users = (
        device_days(flat.where(in_period(as_of, period, history_months)))
        .groupBy("device_id")
        .agg(
            F.min("activity_date").alias("first_activity_date"),
            F.max("activity_date").alias("last_activity_date"),
            F.count("activity_date").alias("total_active_days"),
            F.sum("events").alias("total_events"),
            F.sum("completed").alias("total_anxiety_sessions"),
        )
    )
    first, last, today = F.col("first_activity_date"), F.col("last_activity_date"), F.lit(as_of)
    spans = users.select(
        "*",
        (F.datediff(last, first) + 1).alias("days_since_first_use"),
        F.datediff(today, last).alias("days_since_last_activity"),
        F.datediff(today, first).alias("age"),
    ).withColumn(
        "activity_consistency_percentage", percent("total_active_days", "days_since_first_use", digits=None)
    )
    age, idle = F.col("age"), F.col("days_since_last_activity")
    done, active = F.col("total_anxiety_sessions"), F.col("total_active_days")
    penalty = (
        idle * 5 + flag(F.col("activity_consistency_percentage") < 20) * 20 + flag(done == 0) * 30
    )
    return spans.select(
        "*",
        label([(age <= 7, STAGES[0]), (age <= 30, STAGES[1]), (age <= 90, STAGES[2])], STAGES[3]).alias(
            "user_lifecycle_stage"
        ),
        label(
            [
                ((done >= 10) & (active >= 7), "Highly Engaged"),
                ((done >= 5) & (active >= 3), "Moderately Engaged"),
                (done >= 1, "Lightly Engaged"),
            ],
            "Minimal Engagement",
        ).alias("engagement_level"),
        label([(idle >= 14, "High Risk"), (idle >= 7, "Medium Risk"), (idle >= 3, "Low Risk")], "Active").alias(
            "churn_risk_level"
        ),
        F.greatest(F.lit(0), 100 - penalty).alias("retention_score"),
    ).drop("age")


def retention_churn(
    flat: DataFrame, as_of: date, min_users: int = 3, history_months: int = 1, period: Column | None = None
) -> DataFrame:
    """Cohorts by first month, lifecycle stage, engagement and churn risk, with an action."""
    keys = ["cohort_month", "user_lifecycle_stage", "engagement_level", "churn_risk_level"]
    users = user_lifecycle(flat, as_of, history_months, period).withColumn(
        "cohort_month", F.date_format("first_activity_date", "yyyy-MM")
    )
    idle = F.col("days_since_last_activity")
    everyone = F.count(F.lit(1))
    cohorts = users.groupBy(*keys).agg(
        everyone.alias("user_count"),
        *[
            round_half_up(exact_mean(source) if source == "activity_consistency_percentage" else F.avg(source), 1).alias(name)
            for name, source in {
                "avg_days_since_first_use": "days_since_first_use",
                "avg_days_since_last_activity": "days_since_last_activity",
                "avg_active_days": "total_active_days",
                "avg_anxiety_sessions": "total_anxiety_sessions",
                "avg_consistency_percentage": "activity_consistency_percentage",
                "avg_retention_score": "retention_score",
            }.items()
        ],
        percent(tally(idle <= 7), everyone).alias("seven_day_retention_rate"),
        percent(tally(idle <= 14), everyone).alias("fourteen_day_retention_rate"),
        percent(tally(idle <= 30), everyone, digits=None).alias("within_30"),
        tally(F.col("churn_risk_level") == "High Risk").alias("high_churn_risk_users"),
        tally(F.col("engagement_level") == "Minimal Engagement").alias("minimal_engagement_users"),
    )
    minimal = F.col("engagement_level") == "Minimal Engagement"
    action = label(
        [
            ((F.col("churn_risk_level") == "High Risk") & ~minimal, "Re-engagement Campaign"),
            (minimal & (F.col("user_lifecycle_stage") == STAGES[0]), "Onboarding Optimization"),
            (F.col("within_30") < 50, "Retention Strategy Needed"),
        ],
        "Monitor",
    )
    cohort = Window.partitionBy("cohort_month")  # a few dozen groups per month
    return (
        cohorts.where(F.col("user_count") >= min_users)
        .select(
            *keys,
            "user_count",
            percent("user_count", F.sum("user_count").over(cohort)).alias("percentage_of_cohort"),
            *[c for c in cohorts.columns if c.startswith("avg_")],
            "seven_day_retention_rate",
            "fourteen_day_retention_rate",
            round_half_up("within_30", 2).alias("thirty_day_retention_rate"),
            "high_churn_risk_users",
            "minimal_engagement_users",
            action.alias("recommended_action"),
        )
        .orderBy(
            F.desc("cohort_month"),
            rank_of("user_lifecycle_stage", STAGES),
            rank_of("churn_risk_level", CHURN_LEVELS),
            "engagement_level",
        )
    )
