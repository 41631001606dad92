"""Single features: filters, joins, aggregates, windows, sorts and unions, each as a small query."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.checks.analyses import (
    COMPLETED,
    DAILY_MART,
    DAY,
    FEATURES,
    FLOW,
    FUNNEL,
    LIFECYCLE,
    OPENS,
    PAIRS,
    SIGNALS,
    TIMING,
    TREND,
    _n,
    _type,
)
from lakepulse.checks.base import DONE, MONTH, big, check, pct, quotient, rounded, with_flat, with_mart
from lakepulse.functions.battery import scalar_battery
from lakepulse.functions.exprs import epoch_ms, is_event, ms_date, number, percent, rank_of, ratio, round_half_up, tally
from lakepulse.operators import predicates as P
from lakepulse.operators.rollups import completions, count_ids, device_days, most_common, session_table
from lakepulse.plans import churn, focus, mart, responses, risk, sessions
from lakepulse.sources.fixture import AS_OF, batches, flat, mart_events


def _count(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# Filters


@check("pred_current_period", with_flat(f"SELECT year, month, day, count(*) AS n FROM f WHERE {MONTH} GROUP BY ALL"))
def _(spark, sf):
    return _count(flat(spark, sf).where(P.current_period(AS_OF)), *DAY)


@check(
    "pred_last_n_days",
    with_flat("SELECT CAST(d AS VARCHAR) AS d, count(*) AS n FROM f WHERE d >= DATE '2024-01-31' - 7 GROUP BY d"),
)
def _(spark, sf):
    return _count(flat(spark, sf).where(P.last_days(AS_OF, 7)), ms_date(epoch_ms()).alias("d"))


@check(
    "pred_last_90d_ms",
    with_mart(f"""
SELECT event_type, count(*) AS n FROM ev
  WHERE year >= '2024' AND ts_ms >= {(date(2024, 1, 11) - date(1970, 1, 1)).days * 86_400_000} GROUP BY event_type"""),
)
def _(spark, sf):
    return _count(mart_events(flat(spark, sf)).where(P.since_ms(AS_OF, 20, min_year="2024")), "event_type")


@check(
    "pred_explicit_range",
    with_flat("""
SELECT year, month, day, count(*) AS n FROM f
  WHERE (year = '2023' AND month = '12' AND day >= '15') OR (year = '2024' AND month = '01' AND day <= '15')
  GROUP BY ALL"""),
)
def _(spark, sf):
    return _count(flat(spark, sf).where(P.between_days(date(2023, 12, 15), date(2024, 1, 15))), *DAY)


@check(
    "pred_in_list",
    with_flat("SELECT event_type, count(*) AS n FROM f WHERE event_type IN ('crash', 'first_open', 'error') GROUP BY 1"),
)
def _(spark, sf):
    kinds = ("crash", "first_open", "error")
    return _count(flat(spark, sf).where(is_event(*kinds)), "event_type")


@check(
    "pred_like_any",
    with_flat("""
SELECT device_id, count(*) AS n FROM f
  WHERE focus LIKE '%crisis%' OR focus LIKE '%emergency%' OR focus LIKE '%harm%' GROUP BY device_id"""),
)
def _(spark, sf):
    return _count(flat(spark, sf).where(P.contains_any("focus", risk.CRISIS_WORDS)), "device_id")


@check(
    "pred_not_null_nonempty",
    with_flat("SELECT screen_name, count(*) AS n FROM f WHERE screen_name IS NOT NULL AND screen_name <> '' GROUP BY 1"),
)
def _(spark, sf):
    return _count(flat(spark, sf).where(P.filled("screen_name")), "screen_name")


@check(
    "pred_min_sample",
    with_flat("SELECT device_id, count(*) AS n FROM done GROUP BY device_id HAVING count(*) >= 3"),
)
def _(spark, sf):
    return _count(flat(spark, sf).where(is_event(COMPLETED)), "device_id").where("n >= 3")


@check(
    "pred_having",
    with_flat(f"""
SELECT focus, count(DISTINCT session_id) AS unique_sessions, avg(danger) AS avg_danger, {_n('danger >= 9')} AS extreme
  FROM done GROUP BY focus
  HAVING count(DISTINCT session_id) >= 10 AND avg(danger) >= 5.0 AND count(*) FILTER (WHERE danger >= 9) > 0"""),
)
def _(spark, sf):
    grouped = completions(flat(spark, sf)).groupBy("focus").agg(
        count_ids("session_id").alias("unique_sessions"),
        F.avg("danger_level").alias("avg_danger"),
        tally(F.col("danger_level") >= 9).alias("extreme"),
    )
    return grouped.where("unique_sessions >= 10 and avg_danger >= 5.0 and extreme > 0")


@check(
    "pred_time_slice",
    with_flat(f"""
SELECT event_type, {_n('hr BETWEEN 18 AND 21')} AS peak, {_n('isodow(d) IN (6, 7)')} AS weekend,
    {_n('hr BETWEEN 9 AND 17 AND isodow(d) BETWEEN 1 AND 5')} AS business
  FROM f GROUP BY event_type"""),
)
def _(spark, sf):
    slices = [tally(P.in_time_slice(s)).alias(s) for s in ("peak", "weekend", "business")]
    return flat(spark, sf).groupBy("event_type").agg(*slices)


# Joins


@check(
    "join_left_date_keys",
    with_mart(f"""{DAILY_MART}{OPENS}
SELECT year, month, day, total_events, daily_active_users, new_users_base, day_1_retained
  FROM agg LEFT JOIN kept USING (year, month, day)"""),
)
def _(spark, sf):
    events = mart_events(flat(spark, sf))
    daily, retention = mart.daily_aggregates(events, AS_OF), mart.daily_retention(events, AS_OF)
    joined = daily.join(retention, DAY, "left")
    return joined.select(*DAY, "total_events", "daily_active_users", "new_users_base", "day_1_retained")


@check(
    "join_unnest",
    with_flat("""
SELECT year, month, day, count(*) AS events, count(DISTINCT CAST(event_id[5:] AS BIGINT) // 10) AS batches
  FROM f GROUP BY ALL"""),
)
def _(spark, sf):
    # The filter on its array that Spark adds to ``explode`` would build the events three times.
    rows = batches(spark, sf).select("batch_id", F.explode_outer("events").alias("event"), *DAY).where("event IS NOT NULL")
    return rows.groupBy(*DAY).agg(F.count("event.event_id").alias("events"), count_ids("batch_id").alias("batches"))


NEXT = "device_id, event_id, ms, next_danger, next_prob AS next_probability, next_danger - danger AS danger_change"


def _next(spark, sf):
    pairs = responses.next_session(flat(spark, sf))
    return pairs.select("device_id", "event_id", "ms", "next_danger", "next_probability", "danger_change")


@check("join_next_session", with_flat(f"{PAIRS} SELECT {NEXT} FROM pairs WHERE next_danger IS NOT NULL"))
def _(spark, sf):
    return _next(spark, sf).where(F.col("next_danger").isNotNull())


# Aggregates


@check("agg_count_star", with_flat("SELECT event_type, count(*) AS n FROM f GROUP BY event_type"))
def _(spark, sf):
    return _count(flat(spark, sf), "event_type")


@check(
    "agg_count_distinct",
    with_flat("""
SELECT day, count(DISTINCT device_id) AS devices, count(DISTINCT session_id) AS sessions,
    count(DISTINCT event_type) AS kinds
  FROM f GROUP BY day"""),
)
def _(spark, sf):
    compact = flat(spark, sf).groupBy("day", "device_id", "session_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    ids = {"devices": "device_id", "sessions": "session_id", "kinds": "event_type"}
    return compact.groupBy("day").agg(*[count_ids(c).alias(n) for n, c in ids.items()])


@check(
    "agg_conditional_count",
    with_flat(f"""
SELECT day, {_n(DONE)} AS completions, {_type('screen_view')} AS views, {_type('app_background')} AS backgrounds
  FROM f GROUP BY day"""),
)
def _(spark, sf):
    kinds = {"completions": COMPLETED, "views": "screen_view", "backgrounds": "app_background"}
    return flat(spark, sf).groupBy("day").agg(*[tally(is_event(k)).alias(n) for n, k in kinds.items()])


@check(
    "agg_conditional_distinct",
    with_flat(f"""
SELECT day, count(DISTINCT CASE WHEN {DONE} THEN session_id END) AS completed_sessions,
    count(DISTINCT CASE WHEN event_type = 'first_open' THEN device_id END) AS new_devices
  FROM f GROUP BY day"""),
)
def _(spark, sf):
    compact = flat(spark, sf).groupBy("day", "device_id", "session_id").agg(
        F.max(F.when(is_event(COMPLETED), 1)).alias("done"), F.max(F.when(is_event("first_open"), 1)).alias("opened")
    )
    return compact.groupBy("day").agg(
        count_ids("session_id", F.col("done") == 1).alias("completed_sessions"),
        count_ids("device_id", F.col("opened") == 1).alias("new_devices"),
    )


@check(
    "agg_flag_pivot",
    with_flat("""
SELECT session_id, device_id, max(CASE WHEN event_type = 'screen_view' THEN 1 ELSE 0 END) AS viewed,
    max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed
  FROM f GROUP BY ALL"""),
)
def _(spark, sf):
    return session_table(flat(spark, sf), {"viewed": "screen_view", "failed": "error"})


@check(
    "agg_value_pivot",
    with_flat(f"""{FLOW}
SELECT session_id, device_id, final_response, danger_assessment, probability_assessment FROM s"""),
)
def _(spark, sf):
    values = ["final_response", "danger_assessment", "probability_assessment"]
    return sessions.flow_sessions(flat(spark, sf), AS_OF).select(
        "session_id", "device_id", *values
    )


@check(
    "agg_sum_flags",
    with_flat(f"""{FLOW}
SELECT device_id, {big('sum(foci)')} AS focus_steps, {_n('danger_step')} AS dangers,
    {_n('danger_step AND prob_step')} AS assessed
  FROM s GROUP BY device_id"""),
)
def _(spark, sf):
    rows = sessions.flow_sessions(flat(spark, sf), AS_OF)
    both = F.when((F.col("danger") == 1) & (F.col("probability") == 1), 1).otherwise(0)
    return rows.groupBy("device_id").agg(
        F.sum(F.col("new_focus") + F.col("specific_focus")).alias("focus_steps"),
        F.sum("danger").alias("dangers"),
        F.sum(both).alias("assessed"),
    )


@check(
    "agg_avg_min_max",
    with_flat("""
SELECT focus, avg(danger) AS avg_danger, avg(CASE WHEN response = 'Reduce' THEN prob END) AS avg_reduced,
    min(danger) AS min_danger, max(prob) AS max_prob, min(event_timestamp) AS first_seen
  FROM done GROUP BY focus"""),
)
def _(spark, sf):
    rows = flat(spark, sf).where(is_event(COMPLETED))
    danger, prob = number("danger_level"), number("probability_level")
    return rows.groupBy("focus").agg(
        F.avg(danger).alias("avg_danger"),
        F.avg(F.when(F.col("response") == "Reduce", prob)).alias("avg_reduced"),
        F.min(danger).alias("min_danger"),
        F.max(prob).alias("max_prob"),
        F.min("event_timestamp").alias("first_seen"),
    )


@check(
    "agg_percentile",
    with_flat("""
SELECT day, quantile_disc(duration, 0.5) AS median, quantile_disc(duration, 0.95) AS p95,
    quantile_disc(duration, 0.95) FILTER (WHERE event_type = 'performance') AS p95_performance
  FROM f GROUP BY day"""),
)
def _(spark, sf):
    slow = F.when(is_event("performance"), F.col("duration"))
    return flat(spark, sf).groupBy("day").agg(
        F.percentile_approx("duration", 0.5).alias("median"),
        F.percentile_approx("duration", 0.95).alias("p95"),
        F.percentile_approx(slow, 0.95).alias("p95_performance"),
    )


@check(
    "agg_mode",
    with_flat("""
SELECT device_id, focus AS usual_focus FROM f WHERE focus IS NOT NULL GROUP BY device_id, focus
  QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY count(*) DESC, focus) = 1"""),
)
def _(spark, sf):
    counted = _count(flat(spark, sf).where(F.col("focus").isNotNull()), "device_id", "focus")
    return counted.groupBy("device_id").agg(most_common(F.col("focus"), F.col("n")).alias("usual_focus"))


@check(
    "agg_topn_array",
    with_mart(f"""{FEATURES}
SELECT year, month, day, string_agg(event_name || '=' || usage_count || '/' || unique_users, ',' ORDER BY feature_rank)
    AS top_features
  FROM ranked WHERE feature_rank <= 10 GROUP BY ALL"""),
)
def _(spark, sf):
    top = mart.daily_top_features(mart_events(flat(spark, sf)), AS_OF)
    text = F.transform(
        "top_features",
        lambda f: F.concat(
            f["event_name"], F.lit("="), f["usage_count"].cast("string"), F.lit("/"), f["unique_users"].cast("string")
        ),
    )
    return top.select(*DAY, F.array_join(text, ",").alias("top_features"))


@check(
    "agg_two_level",
    with_flat("""
SELECT device_id, count(*) AS sessions, avg(n) AS avg_events, max(n) AS most_events
  FROM (SELECT device_id, session_id, count(*) AS n FROM f GROUP BY ALL) GROUP BY device_id"""),
)
def _(spark, sf):
    per_session = _count(flat(spark, sf), "device_id", "session_id")
    return per_session.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.avg("n").alias("avg_events"), F.max("n").alias("most_events")
    )


@check(
    "agg_global",
    with_flat(f"SELECT count(*) AS events, {_n(DONE)} AS completions, max(event_timestamp) AS newest FROM f"),
)
def _(spark, sf):
    return flat(spark, sf).agg(
        F.count(F.lit(1)).alias("events"),
        tally(is_event(COMPLETED)).alias("completions"),
        F.max("event_timestamp").alias("newest"),
    )


@check(
    "agg_by_expression",
    with_flat("SELECT strftime(d, '%Y-%m') AS month_text, isodow(d) AS weekday, count(*) AS n FROM f GROUP BY ALL"),
)
def _(spark, sf):
    d = ms_date(epoch_ms())
    return _count(flat(spark, sf), F.date_format(d, "yyyy-MM").alias("month_text"), (F.weekday(d) + 1).alias("weekday"))


@check(
    "agg_ratio",
    with_flat(f"""
SELECT device_id, {pct(_n(DONE), _type('new_focus_selected'))} AS completion_percent,
    {quotient('count(*)', 'count(DISTINCT session_id)')} AS events_per_session
  FROM f GROUP BY device_id"""),
)
def _(spark, sf):
    return flat(spark, sf).groupBy("device_id").agg(
        percent(tally(is_event(COMPLETED)), tally(is_event("new_focus_selected"))).alias("completion_percent"),
        ratio(F.count(F.lit(1)), count_ids("session_id")).alias("events_per_session"),
    )


# Windows


@check(
    "win_share_of_total",
    with_flat(f"""
SELECT event_type, count(*) AS n, {pct('count(*)', 'sum(count(*)) OVER ()')} AS share FROM f GROUP BY event_type"""),
)
def _(spark, sf):
    everything = F.sum("n").over(Window.partitionBy())  # one row per event type
    return _count(flat(spark, sf), "event_type").withColumn("share", percent("n", everything))


@check(
    "win_share_of_partition",
    with_flat(f"""{FLOW}
SELECT danger_assessment, probability_assessment, final_response, response_count,
    {rounded('response_percentage')} AS response_percentage
  FROM shares"""),
)
def _(spark, sf):
    rows = sessions.response_patterns(sessions.flow_sessions(flat(spark, sf), AS_OF))
    return rows.withColumn("response_percentage", round_half_up("response_percentage", 2))


def _signal(name, column):
    @check(name, with_flat(f"{SIGNALS} SELECT device_id, event_id, {column} FROM sig"))
    def _(spark, sf):
        return risk.risk_signals(flat(spark, sf), AS_OF).select("device_id", "event_id", column)


_signal("win_recency_rank", "recency_rank")
_signal("win_partition_count", "total_sessions")
_signal("win_moving_avg_3", "recent_avg_danger")
_signal("win_moving_max_7", "recent_max_danger")


@check(
    "win_first_last_activity",
    with_flat(f"""
, days AS (SELECT device_id, d, count(*) AS n FROM f WHERE {MONTH} GROUP BY ALL)
SELECT device_id, CAST(d AS VARCHAR) AS activity_date, n AS events,
    CAST(min(d) OVER (PARTITION BY device_id) AS VARCHAR) AS first_activity_date,
    CAST(max(d) OVER (PARTITION BY device_id) AS VARCHAR) AS last_activity_date
  FROM days"""),
)
def _(spark, sf):
    device = Window.partitionBy("device_id")  # one row per device and day
    return device_days(flat(spark, sf).where(P.current_period(AS_OF))).select(
        "device_id",
        "activity_date",
        "events",
        F.min("activity_date").over(device).alias("first_activity_date"),
        F.max("activity_date").over(device).alias("last_activity_date"),
    )


@check("win_session_number", with_flat(f"{PAIRS} SELECT device_id, event_id, number AS user_session_number FROM pairs"))
def _(spark, sf):
    return responses.next_session(flat(spark, sf)).select("device_id", "event_id", "user_session_number")


@check("win_trend_5", with_flat(f"{TREND} SELECT device_id, response, event_id, recent_effectiveness_trend FROM trend"))
def _(spark, sf):
    trend = responses.response_trend(flat(spark, sf), AS_OF)
    return trend.select("device_id", "response", "event_id", "recent_effectiveness_trend")


@check("win_lead_next", with_flat(f"{PAIRS} SELECT {NEXT} FROM pairs"))
def _(spark, sf):
    return _next(spark, sf)


# Sorts, limits, unions


@check("sort_simple", with_flat("SELECT year, month, day, count(*) AS n FROM f GROUP BY ALL ORDER BY n DESC, day"))
def _(spark, sf):
    return _count(flat(spark, sf), *DAY).orderBy(F.desc("n"), "day")


RANK = "CASE user_lifecycle_stage WHEN 'New User (0-7 days)' THEN 0 WHEN 'Establishing User (8-30 days)' THEN 1 ELSE 2 END"


@check(
    "sort_case_rank",
    with_flat(f"""{LIFECYCLE}
SELECT user_lifecycle_stage, churn_risk_level, count(*) AS n FROM life GROUP BY 1, 2
  ORDER BY {RANK}, churn_risk_level"""),
)
def _(spark, sf):
    groups = _count(churn.user_lifecycle(flat(spark, sf), AS_OF), "user_lifecycle_stage", "churn_risk_level")
    return groups.orderBy(
        rank_of("user_lifecycle_stage", churn.STAGES), rank_of("churn_risk_level", churn.CHURN_LEVELS)
    )


@check(
    "topk_per_group",
    with_mart(f"""{FEATURES}
SELECT year, month, day, event_name, usage_count, unique_users, feature_rank FROM ranked WHERE feature_rank <= 3"""),
)
def _(spark, sf):
    return mart.top_feature_rows(mart_events(flat(spark, sf)), AS_OF, n=3)


@check(
    "union_all_typed_nulls",
    with_flat("""
SELECT 'all' AS part, count(*) AS n, count(DISTINCT device_id) AS devices, CAST(NULL AS DOUBLE) AS avg_danger FROM f
UNION ALL SELECT response, count(*), NULL, avg(danger) FROM done GROUP BY response"""),
)
def _(spark, sf):
    rows = flat(spark, sf)
    whole = rows.agg(
        F.lit("all").alias("part"), F.count(F.lit(1)).alias("n"), count_ids("device_id").alias("devices")
    )
    parts = completions(flat(spark, sf)).groupBy(F.col("response").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("danger_level").alias("avg_danger")
    )
    return whole.unionByName(parts, allowMissingColumns=True)


@check(
    "union_all_stages",
    with_flat(f"""{FUNNEL}
SELECT 'App Install' AS stage, a AS users FROM n UNION ALL SELECT 'First Anxiety Created', b FROM n
UNION ALL SELECT 'First Session Completed', c FROM n"""),
)
def _(spark, sf):
    kinds = ("app_install", "new_anxiety_created", COMPLETED)
    return sessions.user_journey_funnel(flat(spark, sf), AS_OF).select("stage", "users")


@check(
    "union_all_dims",
    with_flat(f"{TIMING} SELECT analysis_type, time_dimension, time_category, total_events FROM both_ways "
              "WHERE unique_anxiety_sessions > 0"),
)
def _(spark, sf):
    rows = focus.session_timing(flat(spark, sf), AS_OF)
    return rows.select("analysis_type", "time_dimension", "time_category", "total_events")


@check(
    "cte_chain",
    with_flat(f"""{LIFECYCLE}
SELECT * REPLACE (CAST(first_activity_date AS VARCHAR) AS first_activity_date,
    CAST(last_activity_date AS VARCHAR) AS last_activity_date) FROM life"""),
)
def _(spark, sf):
    return churn.user_lifecycle(flat(spark, sf), AS_OF)


# Scalar functions

_SCALARS = {
    "cast": "sum(CAST(danger AS BIGINT))",
    "cast_failed": _n("danger_level IS NOT NULL AND danger IS NULL"),
    "epoch": "sum(date_diff('day', DATE '1970-01-01', d))",
    "date_parts": "sum(hr * 1000000 + isodow(d) * 10000 + year(d) + month(d))",
    "date_arithmetic": _n("d >= DATE '2024-01-31' - 7") + " * 1000 + sum(date_diff('day', d, DATE '2024-01-31'))",
    "date_format": "sum(CAST(strftime(d, '%Y%m') AS BIGINT))",
    "date_parse": "sum(date_diff('day', CAST(strptime(concat(year, '-', month, '-', day), '%Y-%m-%d') AS DATE), "
    "DATE '2024-01-31'))",
    "math": f"sum(CAST(floor({rounded('greatest(10.0e0, duration * 3 - 1) / 7')} * 100 + 0.5e0) AS BIGINT))",
    "conditional": _n("hr BETWEEN 6 AND 11") + " * 1000000 + " + _n("NOT hr BETWEEN 6 AND 17"),
    "nullif": "count(1 / nullif(hr % 3, 0))",
    "string": "sum(length(device_id || '|' || focus))",
    "like": _n("focus LIKE '%Work%' OR focus LIKE '%crisis%'"),
    "between": _n("hr BETWEEN 22 AND 23 OR hr BETWEEN 0 AND 5"),
    "struct": "sum(CAST(floor(struct_extract({'y': duration}, 'y') * 100 + 0.5e0) AS BIGINT))",
    "array": "sum(len(string_split(session_id, '_')))",
}


@check(
    "scalar_battery",
    with_flat(
        " UNION ALL ".join(f"SELECT '{g}' AS function_group, {big(x)} AS checksum FROM f" for g, x in _SCALARS.items())
    ),
)
def _(spark, sf):
    return scalar_battery(flat(spark, sf), AS_OF)
