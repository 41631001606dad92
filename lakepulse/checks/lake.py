"""Sources and sinks: Spark lands the given tables as a lake, then reads it back."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from lakepulse.checks.base import K, SOURCE, big, check, mean, rounded, with_flat
from lakepulse.functions.exprs import exact_mean, round_half_up
from lakepulse.operators.flatten import flatten_events
from lakepulse.operators.predicates import between_days
from lakepulse.plans.mart import write_mart
from lakepulse.session import scratch
from lakepulse.sources import compaction, fixture, lake, listing, sinks, zones
from lakepulse.sources.fixture import AS_OF
from lakepulse.sources.schemas import DAILY, HOURLY

DAY = ["year", "month", "day"]
LANDED: dict = {}


def _landed(spark, sf, name, keys, padded=True):
    """The table ``name`` of the fixture as partitioned JSON."""

    def write(path):
        rows = getattr(fixture, name)(spark, sf)
        if name == "raw_events":
            rows = sinks.with_partitions(rows, "ms").drop("ms")
        sinks.write_json(rows, path, keys)

    return sinks.land_once(spark, LANDED, (name, sf), write)


def landed_batches(spark, sf):
    """Batches are built behind the shuffle by hour, from rows a few percent of their size; so is its unit."""

    def write(path):
        with sinks.target_size(spark, "4MB"):
            sinks.write_json(fixture.balanced_batches(spark, sf), path, sinks.HOURLY, balanced=True)

    return sinks.land_once(spark, LANDED, ("batches", sf), write)


def landed_raw(spark, sf):
    return _landed(spark, sf, "raw_events", sinks.HOURLY)


HOUR_TEXT = "printf('%02d', (src_ms // 3600000) % 24)"
PARTS = "ymd[1:4] AS year, ymd[5:6] AS month, ymd[7:8] AS day"


@check(
    "src_analytics_batches",
    with_flat(f"""
, sizes AS (SELECT CAST(event_id[5:] AS BIGINT) // 10 AS src_id, count(*) AS n FROM flat GROUP BY 1)
SELECT 'batch_' || src_id AS batch_id, src_ms AS batch_timestamp, 'device_' || user_id AS device_id,
    'device_' || user_id || '_' || ymd AS session_id, coalesce(n, 0) AS n_events, {PARTS}, {HOUR_TEXT} AS hour
  FROM src LEFT JOIN sizes USING (src_id)"""),
)
def _(spark, sf):
    return lake.read_batches(spark, landed_batches(spark, sf)).select(
        "batch_id",
        "batch_timestamp",
        "batch_metadata.device_id",
        "batch_metadata.session_id",
        F.coalesce(F.size("events"), F.lit(0)).alias("n_events"),
        *sinks.HOURLY,
    )


# Output names of nested fields that are renamed, and the ones that are filled apart.
_RENAMED = {
    ("focus_session", "duration_seconds"): "focus_duration",
    ("breathing_exercise", "session_duration"): "breathing_duration",
    ("danger_probability", "context"): "danger_context",
}
_FILLED = [
    *[f"{sql} AS {name}" for name, sql in (fixture.OWNER_FILL | fixture.EVENT_FILL).items()],
    *[
        f"{sql} AS {_RENAMED.get((part, name), name)}"
        for part, fields in fixture.PART_FILL.items()
        for name, sql in fields.items()
        if name != "position"
    ],
    "k * 2e0 AS click_x",
    "k * 4e0 AS click_y",
]


@check(
    "flatten_events",
    with_flat(f"""
SELECT 'batch_' || src_id AS batch_id, src_ms AS batch_timestamp, CAST(user_id AS VARCHAR) AS user_id, device_id, session_id,
    event_id, ms AS event_timestamp, event_type, screen_name, duration, danger_level, probability_level, response, focus,
    specific_focus, year, month, day, {HOUR_TEXT} AS hour, * EXCLUDE (src_id, src_ms, user_id, device_id, session_id, event_id,
      ms, event_type, screen_name, duration, danger_level, probability_level, response, focus, specific_focus, year, month, day)
  FROM (
    SELECT src_id, src_ms, user_id, event_id, ms, event_type, device_id, session_id, screen_name, duration, danger_level,
      probability_level, response, focus, specific_focus, year, month, day, {", ".join(_FILLED)}
    FROM (SELECT *, CAST(event_id[5:] AS BIGINT) // 10 AS src_id FROM flat) JOIN (SELECT src_id, src_ms, user_id, k FROM src) USING (src_id)
  )"""),
)
def _(spark, sf):
    return flatten_events(lake.read_batches(spark, landed_batches(spark, sf)), min_year="2024")


@check(
    "src_user_behavior",
    f"""WITH {SOURCE}
SELECT 'bhv_' || src_id AS behavior_id, CAST(user_id AS VARCHAR) AS user_id, src_ms AS "timestamp", kind AS behavior_type,
    k / 100.0e0 AS session_completion_rate, CAST(NULL AS DOUBLE) AS mood_improvement_score,
    CASE WHEN k % 2 = 0 THEN 'evening' ELSE 'night' END AS late_time, k % 9 AS focus_uses,
    user_id % 40 AS days_since_first_use, CAST(k % 2 = 0 AS INTEGER) AS daily_notice,
    CASE WHEN k % 3 = 0 THEN 'all' ELSE 'none' END AS share, value AS battery_level, {PARTS}, {HOUR_TEXT} AS hour
  FROM src""",
)
def _(spark, sf):
    rows = lake.read_user_behavior(spark, _landed(spark, sf, "user_behavior", sinks.HOURLY))
    return rows.select(
        "behavior_id",
        "user_id",
        "timestamp",
        "behavior_type",
        "wellness_metrics.session_completion_rate",
        "wellness_metrics.mood_improvement_score",
        F.col("engagement_patterns.preferred_session_times")[1].alias("late_time"),
        F.col("engagement_patterns.feature_usage_frequency")["focus"].alias("focus_uses"),
        "engagement_patterns.retention_indicators.days_since_first_use",
        F.col("user_preferences.notification_settings")["daily"].cast("int").alias("daily_notice"),
        F.col("user_preferences.privacy_settings")["share"].alias("share"),
        "device_context.battery_level",
        *sinks.HOURLY,
    )


@check(
    "src_feedback",
    f"""WITH {SOURCE}
SELECT 'fb_' || src_id AS feedback_id, 'device_' || user_id AS device_id,
    CASE WHEN k % 4 = 0 THEN 'high' ELSE 'low' END AS severity, 1.0e0 + k % 5 AS user_rating, concat_ws(',', 'app', kind) AS tags,
    k % 3 AS attachments, CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN k * 10 ELSE k * 30 END AS attached_bytes,
    value AS load_time, CAST(k % 10 = 9 AS INTEGER) AS crashed,
    CASE WHEN k % 2 = 0 THEN 'open' ELSE 'resolved' END AS status, {PARTS}
  FROM src""",
)
def _(spark, sf):
    rows = lake.read_feedback(spark, _landed(spark, sf, "feedback", DAY))
    total = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda acc, a: acc + a["size"])
    return rows.select(
        "feedback_id",
        "device_id",
        "severity",
        "user_rating",
        F.array_join("tags", ",").alias("tags"),
        F.size("attachments").alias("attachments"),
        total.alias("attached_bytes"),
        "app_state.performance_metrics.load_time",
        F.col("app_state.performance_metrics.crash_occurred").cast("int").alias("crashed"),
        "processing_status.status",
        *DAY,
    )


@check(
    "src_transactions",
    f"""WITH {SOURCE}
SELECT 'txn_' || src_id AS transaction_id, value AS amount,
    CASE WHEN k % 2 = 0 THEN 'monthly' END AS plan_type, CASE WHEN k % 2 = 0 THEN CAST(k % 4 = 0 AS INTEGER) END AS trial,
    CASE WHEN k % 10 = 9 THEN value END AS refund_amount, CASE WHEN k % 5 = 0 THEN 'WELCOME' END AS promo,
    0.25e0 AS tax_rate, CAST(k % 2 = 1 AS INTEGER) AS receipt_sent, k / 100.0e0 AS risk_score, {PARTS}
  FROM src WHERE kind = 'purchase'""",
)
def _(spark, sf):
    rows = lake.read_transactions(spark, _landed(spark, sf, "transactions", DAY))
    return rows.select(
        "transaction_id",
        "amount",
        "subscription_info.plan_type",
        F.col("subscription_info.trial_period").cast("int").alias("trial"),
        "refund_info.refund_amount",
        F.col("promo_code.code").alias("promo"),
        "tax_info.tax_rate",
        F.col("receipt_info.receipt_sent").cast("int").alias("receipt_sent"),
        "risk_assessment.risk_score",
        *DAY,
    )


_DAY15 = "CAST(ts AS DATE) = DATE '2024-01-15'"


def _one_day(hours):
    return (F.col("year") == 2024) & (F.col("month") == 1) & (F.col("day") == 15) & hours


@check(
    "src_raw_events_by_type",
    f"SELECT event_type, count(*) AS event_count FROM events WHERE {_DAY15} AND hour(ts) = 14 GROUP BY 1",
)
def _(spark, sf):
    raw = lake.read_raw_events(spark, landed_raw(spark, sf))
    return lake.count_by_type(raw, _one_day(F.col("hour") == 14))


@check(
    "src_raw_events_hour_range",
    f"SELECT event_type, count(*) AS event_count FROM events WHERE {_DAY15} AND hour(ts) BETWEEN 10 AND 14 GROUP BY 1",
)
def _(spark, sf):
    raw = lake.read_raw_events(spark, landed_raw(spark, sf))
    return lake.count_by_type(raw, _one_day(F.col("hour").between(10, 14)))


@check(
    "src_metrics_csv",
    f"""
SELECT event_type || '_usage' AS metric_name, 'web-0' || (user_id % 4) AS host, count(*) AS n, {big(f'sum({K}) FILTER (WHERE user_id IS NOT NULL)')} AS k_sum,
    {rounded(mean('value'))} AS avg_value, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS newest
  FROM events GROUP BY ALL""",
)
def _(spark, sf):
    def write(path):
        fixture.host_metrics(spark, sf).write.option("header", True).csv(path)

    rows = lake.read_metrics_csv(spark, sinks.land_once(spark, LANDED, ("metrics", sf), write))
    return rows.groupBy("metric_name", F.col("tags")["host"].alias("host")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("tags")["k"].cast("bigint")).alias("k_sum"),
        round_half_up(exact_mean("value"), 2).alias("avg_value"),
        F.max("timestamp").alias("newest"),
    )


@check(
    "partition_discovery",
    """
SELECT DISTINCT year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour FROM events
  WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)
def _(spark, sf):
    where = between_days(date(2024, 1, 5), date(2024, 1, 20))
    return lake.discover_partitions(spark, landed_raw(spark, sf), where).select(*sinks.HOURLY)


@check(
    "sink_partitioned_json",
    """
SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour,
    count(*) AS n
  FROM events GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch(spark, "sink_json")
    rows = sinks.with_partitions(fixture.raw_events(spark, sf), "ms").drop("ms")
    sinks.write_json(rows, path)
    back = spark.read.schema(f"event_id string, {HOURLY}").json(path)
    return back.groupBy(*sinks.HOURLY).agg(F.count("event_id").alias("n"))


_SUMMARY = (
    "processing_timestamp string, total_events bigint, event_types map<string,bigint>, unique_users bigint, "
    "year int, month int, day int, hour int"
)


@check(
    "sink_processed_summary",
    """
WITH hours AS (
  SELECT date_trunc('hour', ts) AS h, coalesce(event_type, 'unknown') AS event_type, count(*) AS n
  FROM events GROUP BY ALL
), users AS (SELECT date_trunc('hour', ts) AS h, count(DISTINCT user_id) AS unique_users FROM events GROUP BY ALL)
SELECT '2024-01-31 00:00:00' AS processing_timestamp, year(h) AS year, month(h) AS month, day(h) AS day, hour(h) AS hour,
    CAST(sum(n) AS BIGINT) AS total_events, any_value(unique_users) AS unique_users,
    string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS event_types
  FROM hours JOIN users USING (h) GROUP BY h""",
)
def _(spark, sf):
    path = scratch(spark, "processed")
    raw = lake.read_raw_events(spark, landed_raw(spark, sf))
    sinks.write_json(sinks.processed_summary(raw, "2024-01-31 00:00:00"), path)
    back = spark.read.schema(_SUMMARY).json(path)
    entries = F.transform(
        F.array_sort(F.map_entries("event_types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return back.withColumn("event_types", F.array_join(entries, ","))


@check(
    "compact_to_parquet",
    with_flat("""
SELECT year, month, day, count(*) AS events, count(DISTINCT session_id) AS sessions, max(ms) AS newest
  FROM flat GROUP BY ALL"""),
)
def _(spark, sf):
    path = scratch(spark, "compacted")
    events = flatten_events(lake.read_batches(spark, landed_batches(spark, sf)))
    sinks.compact(events.drop("hour"), path, DAY)
    back = spark.read.schema(f"session_id string, event_timestamp bigint, {DAILY}").parquet(path)
    return back.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("session_id").alias("sessions"),
        F.max("event_timestamp").alias("newest"),
    )


@check(
    "tenant_routing",
    """
SELECT coalesce(['tenant-a', 'tenant-b', 'shared'][CAST(user_id % 3 AS INTEGER) + 1], 'shared') AS tenant, strftime(ts, '%Y') AS year,
    strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, count(*) AS n
  FROM events GROUP BY ALL""",
)
def _(spark, sf):
    path = scratch(spark, "tenants")
    rows = sinks.with_partitions(fixture.raw_events(spark, sf), "ms").drop("ms", "hour")
    user = F.substring("user_id", 6, 20).cast("bigint")
    tenant = F.when(user % 3 == 0, "tenant-a").when(user % 3 == 1, "tenant-b").otherwise("shared")
    sinks.write_tenants(rows, path, tenant, DAY)
    back = spark.read.schema(f"event_id string, tenant string, {DAILY}").json(path)
    return back.groupBy("tenant", *DAY).agg(F.count("event_id").alias("n"))


@check(
    "retention_plan",
    f"""
WITH listing AS (
  SELECT CASE event_type WHEN 'error' THEN 'temp/' WHEN 'signup' THEN 'query-results/' WHEN 'view' THEN 'processed/'
    ELSE 'data/' END AS area, event_id, {K} * 1024 AS size,
    date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS age_days
  FROM events
) SELECT area || 'obj_' || event_id || '.json' AS path, size, age_days,
    CASE WHEN age_days < 30 THEN 'STANDARD' WHEN age_days < 90 THEN 'STANDARD_IA' WHEN age_days < 365 THEN 'GLACIER'
      ELSE 'DEEP_ARCHIVE' END AS storage_class,
    CASE WHEN (area = 'temp/' AND age_days >= 7) OR (area = 'query-results/' AND age_days >= 30) THEN 'EXPIRE'
      WHEN age_days >= 30 THEN 'TRANSITION' ELSE 'KEEP' END AS action
  FROM listing""",
)
def _(spark, sf):
    return sinks.retention_plan(fixture.object_listing(spark, sf), AS_OF)


SCAN_LIMIT = 1_000_000


@check(
    "scan_cost_audit",
    f"""
WITH listing AS (SELECT {K} * 1024 AS size, ts FROM events),
scans AS (
  SELECT 'month' AS scan, size FROM listing WHERE ts < TIMESTAMP '2024-02-01'
  UNION ALL SELECT 'day', size FROM listing WHERE CAST(ts AS DATE) = DATE '2024-01-05'
  UNION ALL SELECT 'hour', size FROM listing WHERE date_trunc('hour', ts) = TIMESTAMP '2024-01-05 03:00:00'
), named(scan) AS (VALUES ('month'), ('day'), ('hour'))
SELECT scan, count(size) AS files, coalesce({big('sum(size)')}, 0) AS bytes,
    CAST(coalesce(sum(size), 0) > {SCAN_LIMIT} AS INTEGER) AS over_limit
  FROM named LEFT JOIN scans USING (scan) GROUP BY scan""",
)
def _(spark, sf):
    listing = sinks.with_partitions(fixture.object_listing(spark, sf).withColumn("ms", F.unix_millis("modified")), "ms")
    day = between_days(date(2024, 1, 5), date(2024, 1, 5))
    scans = {
        "month": between_days(date(2024, 1, 1), date(2024, 1, 31)),
        "day": day,
        "hour": day & (F.col("hour") == "03"),
    }
    parts = [lake.scan_cost(listing, where, SCAN_LIMIT).withColumn("scan", F.lit(name)) for name, where in scans.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check(
    "partition_paths",
    """
SELECT event_type, count(*) AS event_count FROM events
  WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' GROUP BY event_type""",
)
def _(spark, sf):
    base = landed_raw(spark, sf)
    paths = lake.partition_paths(base, date(2024, 1, 5), date(2024, 1, 9))
    return lake.count_by_type(lake.read_raw_events(spark, paths, base), F.lit(True))


@check(
    "mart_refresh",
    """
SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day,
    CAST(sum(CASE WHEN day(ts) BETWEEN 10 AND 12 THEN 2 ELSE 1 END) AS BIGINT) AS events
  FROM events GROUP BY ALL""",
)
def _(spark, sf):
    """All days, then three of them anew with twice the count; the others stay."""
    path = scratch(spark, "refreshed")
    rows = sinks.with_partitions(fixture.raw_events(spark, sf), "ms")
    daily = rows.groupBy(*DAY).agg(F.count(F.lit(1)).alias("events"))
    write_mart(daily, path)
    write_mart(daily.where(F.col("day").between("10", "12")).withColumn("events", F.col("events") * 2), path)
    return spark.read.schema(f"events bigint, {DAILY}").parquet(path)


@check(
    "partition_changes",
    """
SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day,
    CASE WHEN day(ts) = 3 THEN 'dropped' WHEN day(ts) = 30 THEN 'added' ELSE 'changed' END AS change,
    CAST(day(ts) <> 30 AS INTEGER) AS files_before, CASE WHEN day(ts) = 3 THEN 0 WHEN day(ts) = 30 THEN 1 ELSE 2 END AS files_after
  FROM events WHERE day(ts) IN (3, 30) OR day(ts) BETWEEN 10 AND 12 GROUP BY ALL""",
)
def _(spark, sf):
    """One day is landed later, one is deleted, three get another file."""
    path = scratch(spark, "changing")
    rows = sinks.with_partitions(fixture.raw_events(spark, sf), "ms").repartition(*DAY)
    rows.where("day <> '30'").write.partitionBy(*DAY).parquet(path)
    before = listing.list_files(spark, path)
    rows.where("day = '30' OR day BETWEEN '10' AND '12'").write.mode("append").partitionBy(*DAY).parquet(path)
    after = listing.list_files(spark, path).where("path NOT LIKE '%/day=03/%'")
    return listing.partition_changes(before, after).select(*DAY, "change", "files_before", "files_after")


@check(
    "compaction",
    """
SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, event_type,
    count(*) AS events, count(DISTINCT user_id) AS users, 1 AS files
  FROM events GROUP BY ALL""",
)
def _(spark, sf):
    """Days land in several small files each, in two goes; afterwards each day is one file."""
    path = scratch(spark, "packed")
    schema = f"event_id string, user_id string, event_type string, {DAILY}"
    rows = sinks.with_partitions(fixture.raw_events(spark, sf), "ms").select("event_id", "user_id", "event_type", *DAY)
    late = F.pmod(F.xxhash64("event_id"), F.lit(5)) == 0
    for part in (rows.where(~late), rows.where(late)):
        part.repartition(3).write.mode("append").partitionBy(*DAY).parquet(path)
        compaction.compact_small(spark, path, schema)
    live = compaction.read_live(spark, path, schema)
    keys = [F.regexp_extract("directory", f"{k}=([0-9]+)", 1).alias(k) for k in DAY]
    files = compaction.manifest(spark, path).where("live").groupBy(*keys).agg(F.count(F.lit(1)).alias("files"))
    counted = live.groupBy(*DAY, "event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))
    return counted.join(files, DAY, "left")


@check(
    "zone_scan_cost",
    f"""
WITH src AS (SELECT epoch_us(ts) // 1000 AS ms, CAST(ts AS DATE) AS d, event_id FROM events),
days AS (SELECT d, min(ms) AS low_ms, max(ms) AS high_ms, min(event_id) AS low_id, max(event_id) AS high_id, count(*) AS n FROM src GROUP BY d),
ends AS (SELECT epoch_ms(TIMESTAMP '2024-01-05 03:00:00') AS lo, epoch_ms(TIMESTAMP '2024-01-09 15:00:00') AS hi),
scans AS (
  SELECT 'time' AS scan, n FROM days, ends WHERE high_ms >= lo AND low_ms <= hi
  UNION ALL SELECT 'time_and_id', n FROM days, ends WHERE high_ms >= lo AND low_ms <= hi AND low_id <= 50
  UNION ALL SELECT 'no_user', count(*) FROM src JOIN events USING (event_id) GROUP BY d HAVING count(user_id) < count(*)
), named(scan) AS (VALUES ('time'), ('time_and_id'), ('no_user'))
SELECT scan, count(n) AS files, count(n) AS row_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, 0 AS over_limit
  FROM named LEFT JOIN scans USING (scan) GROUP BY scan""",
)
def _(spark, sf):
    """Days of one file each; filters on columns that no directory is named after."""
    path = scratch(spark, "zoned")
    rows = sinks.with_partitions(
        fixture.events(spark, sf).select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")), "ms"
    )
    rows.repartition(*DAY).write.partitionBy(*DAY).parquet(path)
    zone = zones.zone_map(spark, path, "ms bigint, event_id bigint, user_id bigint")
    at = lambda text: int(datetime.fromisoformat(text + "+00:00").timestamp() * 1000)
    time = zones.between("ms", at("2024-01-05T03:00:00"), at("2024-01-09T15:00:00"))
    scans = {"time": time, "time_and_id": time & zones.between("event_id", high=50), "no_user": zones.is_null("user_id")}
    parts = [zones.scan_cost(zone, w, 1 << 40).drop("bytes").withColumn("scan", F.lit(n)) for n, w in scans.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
