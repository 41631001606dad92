"""The daily metrics mart: aggregates, retention, top features, and their join."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.functions.exprs import DAY_MS, WIDE, flag, is_event, mean_of_micros, micros, ratio, round_half_up, tally
from lakepulse.operators.predicates import since_ms
from lakepulse.operators.rollups import most_common
from lakepulse.session import written

DAY = ["year", "month", "day"]
HORIZONS = (1, 7, 30)


VALUES = ["event_type", "event_name", "screen_name", "app_version", "country", "subscription_status", "device_type"]


def recent(events: DataFrame, as_of: date, days: int = 90, min_year: str | None = None) -> DataFrame:
    """What the mart reads of its events. Written as it comes, without a shuffle, so events are read and mapped once.

    Counting events by all of these columns first would shuffle nearly as many rows as there are events.
    """
    rows = events.where(since_ms(as_of, days, min_year=min_year))
    return rows.select(*DAY, "user_id", "session_id", *VALUES, "ts_ms", "duration")


def facts_of(rows: DataFrame) -> DataFrame:
    """Events as counts: each with its number, its exact duration sum, and its first and last time."""
    return rows.select(
        *DAY,
        _day_number().alias("d"),
        "user_id",
        "session_id",
        *VALUES,
        F.lit(1).cast("long").alias("n"),
        micros("duration").alias("duration_sum"),
        F.col("duration").isNotNull().cast("long").alias("duration_n"),
        F.col("ts_ms").alias("oldest"),
        F.col("ts_ms").alias("newest"),
    )


def facts(events: DataFrame, as_of: date, days: int = 90, min_year: str | None = None) -> DataFrame:
    """Everything in the mart but the percentiles follows from this table."""
    return facts_of(recent(events, as_of, days, min_year))


def percentiles_of(rows: DataFrame) -> DataFrame:
    load_time = F.when(is_event("performance"), F.col("duration"))
    return rows.groupBy(*DAY).agg(
        F.percentile_approx("duration", 0.5).alias("median_session_duration"),
        F.percentile_approx(load_time, 0.95).alias("p95_performance_load_time"),
    )


def daily_percentiles(events: DataFrame, as_of: date, days: int = 90, min_year: str | None = None) -> DataFrame:
    return percentiles_of(events.where(since_ms(as_of, days, min_year=min_year)))


def daily_aggregates(events: DataFrame, as_of: date, days: int = 90, min_year: str | None = None) -> DataFrame:
    """Per day: users, segments, versions, countries, event mix, durations and quality."""
    rows = written(recent(events, as_of, days, min_year), "mart-events")
    return aggregates_of(facts_of(rows), percentiles_of(rows))


def aggregates_of(counted: DataFrame, medians: DataFrame) -> DataFrame:
    """The daily aggregates from ``facts`` and percentiles.

    Users, sessions and sums come from one compact (day, user, session) table, the low-cardinality dimensions from
    counted values.
    """
    kind = {
        "session_starts": "session_start",
        "screen_views": "screen_view",
        "user_actions": "user_action",
        "feature_usages": "feature_usage",
        "errors": "error",
        "crashes": "crash",
    }
    segments = {
        "new_users": is_event("first_open"),
        "premium_users": F.col("subscription_status") == "premium",
        "free_users": F.col("subscription_status") == "free",
        "iphone_users": F.col("device_type") == "iPhone",
        "ipad_users": F.col("device_type") == "iPad",
        "android_users": F.col("device_type") == "Android",
    }
    only = lambda event, c: F.sum(F.when(is_event(event), F.col(c)))
    sums = {"total_events": F.sum("n"), **{n: F.coalesce(only(k, "n"), F.lit(0)) for n, k in kind.items()}}
    sums |= {"duration_sum": F.sum("duration_sum"), "duration_n": F.sum("duration_n")}
    sums |= {"load_sum": only("performance", "duration_sum"), "load_n": only("performance", "duration_n")}
    wide = ("duration_sum", "load_sum")  # 64 bits hold those of a session, but maybe not those of a day
    compact = counted.groupBy(*DAY, "user_id", "session_id").agg(
        *[F.max(flag(c)).alias(n) for n, c in segments.items()], *[c.alias(n) for n, c in sums.items()]
    )
    # Each compact row counts once for its user and once for its session, in a single shuffle.
    ids = F.array(
        F.struct(F.lit("user").alias("of"), F.col("user_id").alias("id")),
        F.struct(F.lit("session").alias("of"), F.col("session_id").alias("id")),
    )
    per_id = (
        compact.select("*", F.inline(ids))
        .groupBy(*DAY, "of", "id")
        .agg(*[F.max(n).alias(n) for n in segments], *[F.sum(n).alias(n) for n in sums])
    )
    user = (F.col("of") == "user") & F.col("id").isNotNull()
    session = F.col("of") == "session"
    volumes = per_id.groupBy(*DAY).agg(
        tally(user).alias("daily_active_users"),
        tally(session & F.col("id").isNotNull()).alias("total_sessions"),
        *[tally(user & (F.col(n) == 1)).alias(n) for n in segments],
        *[F.sum(F.when(session, F.col(n).cast(WIDE) if n in wide else F.col(n))).alias(n) for n in sums],
    )

    values = counted.select(
        *DAY,
        "n",
        F.expr(
            "stack(4, 'screen', screen_name, 'event', event_name, 'version', app_version, 'country', country)"
            " as (dim, value)"
        ),
    ).where(F.col("value").isNotNull())
    by_value = values.groupBy(*DAY, "dim", "value").agg(F.sum("n").alias("n"))
    of = lambda dim: F.when(F.col("dim") == dim, F.col("value"))
    dims = by_value.groupBy(*DAY).agg(
        F.count(of("screen")).alias("unique_screens_accessed"),
        F.count(of("event")).alias("unique_events_triggered"),
        F.count(of("version")).alias("app_versions_active"),
        most_common(of("version"), F.col("n")).alias("most_common_app_version"),
        F.count(of("country")).alias("countries_active"),
        most_common(of("country"), F.col("n")).alias("most_common_country"),
    )

    joined = volumes.join(medians, DAY, "left").join(dims, DAY, "left")
    rate = lambda part, whole: round_half_up(ratio(part, whole, digits=None) * 100.0, 4)
    counts = ["unique_screens_accessed", "unique_events_triggered", "app_versions_active", "countries_active"]
    return joined.fillna(0, subset=counts).select(
        *DAY, "daily_active_users", "new_users", "total_sessions", "total_events",
        mean_of_micros("duration_sum", "duration_n").alias("avg_session_duration"), "median_session_duration", "unique_screens_accessed", "unique_events_triggered", "premium_users",
        "free_users", "iphone_users", "ipad_users", "android_users", "app_versions_active",
        "most_common_app_version", "countries_active", "most_common_country", *kind,
        mean_of_micros("load_sum", "load_n").alias("avg_performance_load_time"), "p95_performance_load_time",
        rate("errors", "total_events").alias("error_rate_percent"),
        rate("crashes", "total_sessions").alias("crash_rate_percent"),
    )


def _day_number() -> Column:
    return F.floor(F.col("ts_ms") / DAY_MS)


def _return_windows(user_days: DataFrame) -> DataFrame:
    """Add, per user and day number ``d``, the newest event ``h`` days on and the oldest ``h + 1`` days on.

    An event in ``[t + h days, t + (h + 1) days)`` lies either late on day ``d + h`` or early on day
    ``d + h + 1``, ``d`` being the day of ``t``. So the first and last event of each user-day decide
    whether one exists, and neither a self-join nor a window over raw events is needed.
    """
    w = Window.partitionBy("user_id").orderBy("d")  # bounded by the days in the lake
    return user_days.select(
        "*",
        *[F.max("newest").over(w.rangeBetween(h, h)).alias(f"newest_{h}") for h in HORIZONS],
        *[F.min("oldest").over(w.rangeBetween(h + 1, h + 1)).alias(f"oldest_{h}") for h in HORIZONS],
    )


def _came_back(h: int, first: Column, last: Column) -> Column:
    """A NULL user never comes back, as it equals no other."""
    late = F.col(f"newest_{h}") >= first + h * DAY_MS
    early = F.col(f"oldest_{h}") < last + (h + 1) * DAY_MS
    return flag(F.col("user_id").isNotNull() & (F.coalesce(late, F.lit(False)) | F.coalesce(early, F.lit(False))))


def first_open_returns(events: DataFrame, as_of: date, days: int = 90, min_year: str | None = None) -> DataFrame:
    """Each first open with flags for a return on the 1st, 7th and 30th day after it."""
    recent = events.where(since_ms(as_of, days, min_year=min_year))
    opens = recent.where(is_event("first_open"))
    # A return lies after its first open, so nothing older than the period can matter.
    user_days = (
        recent.where(F.col("user_id").isNotNull())
        .groupBy("user_id", _day_number().alias("d"))
        .agg(F.min("ts_ms").alias("oldest"), F.max("ts_ms").alias("newest"))
    )
    joined = opens.withColumn("d", _day_number()).join(_return_windows(user_days), ["user_id", "d"], "left")
    t = F.col("ts_ms")
    return joined.select("user_id", "ts_ms", *DAY, *[_came_back(h, t, t).alias(f"day_{h}") for h in HORIZONS])


def daily_retention(events: DataFrame, as_of: date, days: int = 90, min_year: str | None = None) -> DataFrame:
    """Per day of first open: users, and how many of them came back 1, 7 and 30 days later."""
    rows = events.where(since_ms(as_of, days, min_year=min_year))
    return retention_of(rows.withColumn("d", _day_number()), "ts_ms", "ts_ms")


def retention_of(rows: DataFrame, oldest: str = "oldest", newest: str = "newest") -> DataFrame:
    """Retention from ``facts``, or from events with their day number ``d`` and time.

    Of a user's first opens within one day only the earliest and the latest can decide, so one table
    of (user, day) spans serves both sides: one scan, and no join. Only user and day are shuffled.
    """
    opened = is_event("first_open")
    spans = rows.groupBy("user_id", "d", *DAY).agg(
        F.min(oldest).alias("oldest"),
        F.max(newest).alias("newest"),
        F.min(F.when(opened, F.col(oldest))).alias("first"),
        F.max(F.when(opened, F.col(newest))).alias("last"),
    )
    opens = _return_windows(spans).where(F.col("first").isNotNull())
    users = opens.groupBy(*DAY, "user_id").agg(
        *[F.max(_came_back(h, F.col("first"), F.col("last"))).alias(f"back_{h}") for h in HORIZONS]
    )
    return users.groupBy(*DAY).agg(
        F.count("user_id").alias("new_users_base"),
        *[F.sum(f"back_{h}").alias(f"day_{h}_retained") for h in HORIZONS],
    )


def top_feature_rows(
    events: DataFrame, as_of: date, n: int = 10, days: int = 90, min_year: str | None = None
) -> DataFrame:
    """The ``n`` most used features of each day, one row each."""
    return feature_rows_of(events.where(since_ms(as_of, days, min_year=min_year)), n, F.lit(1))


def feature_rows_of(rows: DataFrame, n: int = 10, count: Column | str = "n") -> DataFrame:
    """The same from ``facts``, or from events that count once each."""
    used = rows.where(is_event("feature_usage"))
    compact = used.groupBy(*DAY, "event_name", "user_id").agg(F.sum(count).alias("n"))
    features = compact.groupBy(*DAY, "event_name").agg(
        F.sum("n").alias("usage_count"), F.count("user_id").alias("unique_users")
    )
    w = Window.partitionBy(*DAY).orderBy(F.desc("usage_count"), "event_name")
    return features.withColumn("feature_rank", F.row_number().over(w)).where(F.col("feature_rank") <= n)


def daily_top_features(
    events: DataFrame, as_of: date, n: int = 10, days: int = 90, min_year: str | None = None
) -> DataFrame:
    """Per day: an array of its top features, most used first."""
    return features_of(top_feature_rows(events, as_of, n, days, min_year))


def features_of(ranked: DataFrame) -> DataFrame:
    item = F.struct("feature_rank", "event_name", "usage_count", "unique_users")
    ordered = F.sort_array(F.collect_list(item))  # at most n items
    return ranked.groupBy(*DAY).agg(
        F.transform(
            ordered,
            lambda f: F.struct(
                f["event_name"].alias("event_name"),
                f["usage_count"].alias("usage_count"),
                f["unique_users"].alias("unique_users"),
            ),
        ).alias("top_features")
    )


def daily_metrics_mart(events: DataFrame, as_of: date, days: int = 90, min_year: str | None = None) -> DataFrame:
    """The mart: one row per day, from one pruned scan of the events, whose columns are written once.

    All inputs are already one row per day when joined.
    """
    rows = written(recent(events, as_of, days, min_year), "mart-events")
    return metrics_of(facts_of(rows), percentiles_of(rows))


def metrics_of(counted: DataFrame, medians: DataFrame, only: Column | None = None) -> DataFrame:
    """The mart from ``facts`` and percentiles; with ``only``, the days that this filter on directories names."""
    own = counted if only is None else counted.where(only)
    daily = aggregates_of(own, medians)
    retention = retention_of(counted)
    features = features_of(feature_rows_of(own))
    joined = daily.join(retention, DAY, "left").join(features, DAY, "left")
    whole = lambda part, base: round_half_up(ratio(part, base, digits=None) * 100.0, 2)
    return joined.select(
        *DAY,
        F.make_date(*[F.col(c).cast("int") for c in DAY]).alias("date_value"),
        "daily_active_users", "new_users", "total_sessions", "total_events",
        ratio("total_sessions", "daily_active_users").alias("avg_sessions_per_user"),
        ratio("total_events", "daily_active_users").alias("avg_events_per_user"),
        ratio("total_events", "total_sessions").alias("avg_events_per_session"),
        round_half_up("avg_session_duration", 2).alias("avg_session_duration_seconds"),
        round_half_up("median_session_duration", 2).alias("median_session_duration_seconds"),
        "unique_screens_accessed", "unique_events_triggered", "premium_users", "free_users",
        whole("premium_users", "daily_active_users").alias("premium_user_percentage"),
        "iphone_users", "ipad_users", "android_users", "app_versions_active", "most_common_app_version",
        "countries_active", "most_common_country", "session_starts", "screen_views", "user_actions",
        "feature_usages", "errors", "crashes",
        round_half_up("avg_performance_load_time", 2).alias("avg_performance_load_time_ms"),
        round_half_up("p95_performance_load_time", 2).alias("p95_performance_load_time_ms"),
        "error_rate_percent", "crash_rate_percent", "new_users_base",
        *[f"day_{h}_retained" for h in HORIZONS],
        *[whole(f"day_{h}_retained", "new_users_base").alias(f"day_{h}_retention_rate") for h in HORIZONS],
        "top_features",
    ).orderBy(*DAY)


def write_mart(mart: DataFrame, path: str) -> None:
    """Refresh the days present in ``mart`` and leave the others alone."""
    (
        mart.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*DAY)
        .parquet(path)
    )
