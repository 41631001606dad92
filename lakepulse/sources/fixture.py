"""Maps the driver's ``events`` table onto the shapes of the lake.

Everything here is a narrow, per-row mapping of the whole table: each source event fans out into a
short fixed list of steps (at most nine), so no shuffle and no grouping is needed to build the lake.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2024, 1, 31)

# Fixed values: (source type, step number, event type, modulus, lowest remainder).
STEPS = [
    ("view", 0, "screen_view", 1, 0),
    ("signup", 0, "app_install", 2, 1),
    ("signup", 1, "first_open", 4, 1),
    ("signup", 2, "new_anxiety_created", 3, 1),
    ("click", 0, "session_start", 1, 0),
    ("click", 1, "user_action", 1, 0),
    ("click", 2, "feature_usage", 2, 1),
    ("click", 3, "app_background", 4, 1),
    ("click", 4, "app_foreground", 4, 2),
    ("error", 0, "error", 1, 0),
    ("error", 1, "crash", 10, 9),
    ("error", 2, "performance", 2, 1),
    ("purchase", 0, "new_focus_selected", 4, 1),
    ("purchase", 1, "specific_focus_selected", 3, 1),
    ("purchase", 2, "danger_level_selected", 10, 1),
    ("purchase", 3, "probability_level_selected", 7, 1),
    ("purchase", 4, "response_selected", 5, 1),
    ("purchase", 5, "be_cool_step_completed", 6, 1),
    ("purchase", 6, "believe_step_completed", 6, 2),
    ("purchase", 7, "behave_step_completed", 6, 3),
    ("purchase", 8, "anxiety_session_completed", 8, 1),
]
DONE = "anxiety_session_completed"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _millis() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(
        "event_id AS src_id",
        "user_id",
        "event_type AS src",
        "value",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS ms",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "date_format(ts, 'yyyyMMdd') AS ymd",
    )


def _steps_of() -> str:
    """The literal list of steps for a source type; constant folded, so it costs nothing per row."""
    arms = []
    for name in dict.fromkeys(s[0] for s in STEPS):
        items = [
            f"named_struct('step', {n}, 'type', '{kind}', 'm', {m}, 'r', {r})"
            for src, n, kind, m, r in STEPS
            if src == name
        ]
        if items:
            arms.append(f"WHEN '{name}' THEN array({', '.join(items)})")
    return f"CASE src {' '.join(arms)} END"


def _pick(key: str, labels: list[str], default: str | None = None) -> str:
    arms = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(labels))
    return f"CASE {key} {arms} {'' if default is None else f'ELSE {default!r}'} END"


def _fields() -> dict[str, str]:
    """The event's own columns, for a step ``s``; they serve exploded rows and ``transform`` alike."""
    done = f"s.type = '{DONE}'"
    quiet = _pick("k % 6", ["Health Concerns", "Work Stress", "Relationships", "Financial Worries"])
    return {
        "event_id": "concat('evt_', CAST(src_id * 10 + s.step AS STRING))",
        "ms": "ms + s.step * 1000",
        "screen_name": "CASE WHEN s.type = 'screen_view' THEN "
        + _pick("k % 7", ["Home", "Focus", "Assess", "Respond", "History", ""])
        + " END",
        "danger_level": "CASE WHEN s.type = 'danger_level_selected' THEN "
        + _pick("k % 4", ["Low", "Medium", "High"], "Very High")
        + f" WHEN {done} THEN CAST(1 + user_id % 5 + k % 6 AS STRING) END",
        "probability_level": "CASE WHEN s.type = 'probability_level_selected' THEN "
        + _pick("k % 4", ["Medium", "Low", "Very High"], "High")
        + f" WHEN {done} THEN CAST(1 + (user_id + k) % 10 AS STRING) END",
        "response": f"CASE WHEN s.type = 'response_selected' OR {done} THEN "
        + _pick("k % 3", ["Reduce", "Maintain"], "Increase")
        + " END",
        "focus": f"CASE WHEN s.type = 'new_focus_selected' OR {done} THEN CASE WHEN k % 6 = 4 THEN "
        f"CASE WHEN user_id % 10 = 0 THEN 'crisis support' ELSE 'Sleep' END ELSE {quiet} END END",
        "specific_focus": f"CASE WHEN s.type = 'specific_focus_selected' OR {done} THEN "
        + _pick("k % 2", ["Physical symptoms"], "Job security")
        + " END",
    }


# Columns that every event of a source row shares.
OWNER = {
    "device_id": "concat('device_', CAST(user_id AS STRING))",
    "session_id": "concat('device_', CAST(user_id AS STRING), '_', ymd)",
    "year": "substring(ymd, 1, 4)",
    "month": "substring(ymd, 5, 2)",
    "day": "substring(ymd, 7, 2)",
}
HOUR = "date_format(timestamp_millis(ms), 'HH') AS hour"


def _owner(*names: str) -> list[str]:
    return [f"{OWNER[n]} AS {n}" for n in names]


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event."""
    rows = _raw(spark, sf_dir).selectExpr("*", f"explode({_steps_of()}) AS s").where("k % s.m >= s.r")
    fields = _fields()
    texts = ("screen_name", "danger_level", "probability_level", "response", "focus", "specific_focus")
    return rows.selectExpr(
        f"{fields['event_id']} AS event_id",
        *_owner("device_id", "session_id"),
        "s.type AS event_type",
        f"CAST({fields['ms']} AS STRING) AS event_timestamp",
        *[f"{fields[c]} AS {c}" for c in texts],
        "value AS duration",
        *_owner("year", "month", "day"),
    )


# How the fields that no analysis reads are filled, in SQL that both engines understand.
OWNER_FILL = {
    "app_version": "concat('1.0.', CAST(k % 3 AS STRING))",
    "os_version": "CAST(15 + k % 4 AS STRING)",
    "device_model": "CASE WHEN k % 4 = 3 THEN NULL ELSE concat('model_', CAST(k % 4 AS STRING)) END",
    "platform": "CASE WHEN k % 2 = 0 THEN 'ios' ELSE 'android' END",
    "timezone": "CASE WHEN k % 5 = 0 THEN 'UTC' ELSE 'Europe/Paris' END",
    "network_type": "CASE WHEN k % 3 = 0 THEN 'wifi' ELSE 'cell' END",
}
EVENT_FILL = {
    "event_name": "concat('name_', CAST(k % 12 AS STRING))",
    "action": "CASE WHEN k % 2 = 0 THEN 'tap' END",
    "category": "concat('cat_', CAST(k % 6 AS STRING))",
    "label": "CASE WHEN k % 7 > 0 THEN concat('label_', CAST(k AS STRING)) END",
    "value": "k / 4e0",
}
PART_FILL = {
    "focus_session": {
        "session_type": "concat('type_', CAST(k % 3 AS STRING))",
        "duration_seconds": "k * 1.5e0",
        "completion_rate": "k / 128e0",
        "technique_used": "concat('focus_', CAST(k % 4 AS STRING))",
        "difficulty_level": "CASE WHEN k % 2 = 0 THEN 'easy' ELSE 'hard' END",
        "mood_before": "concat('before_', CAST(k % 5 AS STRING))",
        "mood_after": "concat('after_', CAST(k % 4 AS STRING))",
        "interruptions": "k % 9",
    },
    "breathing_exercise": {
        "exercise_type": "concat('breath_', CAST(k % 3 AS STRING))",
        "breaths_per_minute": "4 + k / 16e0",
        "total_breaths": "k * 3",
        "session_duration": "k * 2.5e0",
        "pattern_type": "concat('pattern_', CAST(k % 4 AS STRING))",
        "guide_used": "k % 2 = 1",
        "completion_status": "CASE WHEN k % 3 = 0 THEN 'done' ELSE 'left' END",
    },
    "danger_probability": {
        "context": "concat('context_', CAST(k % 8 AS STRING))",
        "user_confidence": "k / 8e0",
        "technique_applied": "concat('technique_', CAST(k % 5 AS STRING))",
        "outcome_rating": "CASE WHEN k % 3 = 1 THEN 'better' END",
    },
    "user_interaction": {
        "interaction_type": "CASE WHEN k % 2 = 0 THEN 'tap' ELSE 'swipe' END",
        "element_id": "concat('element_', CAST(k % 10 AS STRING))",
        "position": "named_struct('x', k * 2e0, 'y', k * 4e0)",
        "gesture": "concat('gesture_', CAST(k % 6 AS STRING))",
        "response_time_ms": "k * 10",
    },
}


def _struct(fields: dict[str, str]) -> str:
    return f"named_struct({', '.join(f'{name!r}, {value}' for name, value in fields.items())})"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once, also where Spark moves or repeats the expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested event batches: one batch per source event holding its steps, which may be none."""
    return batches_of(_raw(spark, sf_dir))


def balanced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the rows of an hour brought together while they are narrow source rows."""
    return batches_of(_raw(spark, sf_dir).selectExpr("*", HOUR).hint("rebalance", F.col("ymd"), F.col("hour")))


def batches_of(raw: DataFrame) -> DataFrame:
    """What the events of a batch share is computed once for it, and not once for each event."""
    f = _fields()
    levels = {"danger_level": f["danger_level"], "probability_level": f["probability_level"]}
    shared = EVENT_FILL | {name: _struct(fill) for name, fill in PART_FILL.items()}
    of = {name: f"same.{name}" for name in shared}
    context = _struct(levels | {n: f"same.danger_probability.{n}" for n in PART_FILL["danger_probability"]})
    event = _struct(
        {"event_id": f["event_id"], "timestamp": f["ms"], "event_type": "s.type", "screen_name": f["screen_name"]}
        | {name: of[name] for name in EVENT_FILL}
        | {"duration": "value"}
        | {name: of[name] for name in PART_FILL}
        | {"danger_probability": context}
        | {"response": f["response"], "focus": f["focus"], "specific_focus": f["specific_focus"]}
    )
    steps = f"transform(filter({_steps_of()}, s -> k % s.m >= s.r), s -> {event})"
    owner = {"user_id": "CAST(user_id AS STRING)", "device_id": OWNER["device_id"], "session_id": OWNER["session_id"]}
    return raw.selectExpr(
        "concat('batch_', CAST(src_id AS STRING)) AS batch_id",
        "ms AS batch_timestamp",
        f"{_struct(owner | OWNER_FILL)} AS batch_metadata",
        f"{_let('k', 'k', _let('same', _struct(shared), steps))} AS events",
        *_owner("year", "month", "day"),
        HOUR,
    )


def mart_events(flat_rows: DataFrame) -> DataFrame:
    """The product-event shape of the daily mart."""
    user = "CAST(substring(device_id, 8, 20) AS INT)"
    return flat_rows.selectExpr(
        "device_id AS user_id",
        "session_id",
        "event_type",
        "concat(event_type, '_', CAST(CAST(floor(duration) AS INT) % 12 AS STRING)) AS event_name",
        "CAST(event_timestamp AS BIGINT) AS ts_ms",
        "duration",
        "screen_name",
        f"CASE WHEN {user} % 4 = 0 THEN 'premium' ELSE 'free' END AS subscription_status",
        f"{_pick(f'{user} % 3', ['iPhone', 'iPad'], 'Android')} AS device_type",
        "CASE WHEN day < '15' THEN '1.0.0' ELSE '1.1.0' END AS app_version",
        f"{_pick(f'{user} % 5', ['US', 'CA', 'GB', 'DE'], 'FR')} AS country",
        "year",
        "month",
        "day",
    )


def mart_history(rows: DataFrame, days: int = 30) -> DataFrame:
    """The same product events once more, so many days earlier."""
    shifted = rows.withColumn("ts_ms", F.col("ts_ms") - days * 86_400_000)
    day = F.timestamp_millis("ts_ms")
    parts = {c: F.date_format(day, f) for c, f in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))}
    return rows.unionByName(shifted.withColumns(parts))


def http_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return events(spark, sf_dir).select(
        _millis().alias("ms"),
        (F.col("value").cast("double") / 100.0).alias("latency_s"),
        F.when(failed & (_k() % 2 == 0), 1).otherwise(0).alias("is_4xx"),
        F.when(failed & (_k() % 2 == 1), 1).otherwise(0).alias("is_5xx"),
    )


def host_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the host that served them."""
    failed = F.col("event_type") == "error"
    return events(spark, sf_dir).select(
        _millis().alias("ms"),
        F.concat(F.lit("web-"), (F.col("user_id") % 4).cast("string")).alias("host"),
        F.when(failed & (_k() % 2 == 0), 1).otherwise(0).alias("is_4xx"),
        F.when(failed & (_k() % 2 == 1), 1).otherwise(0).alias("is_5xx"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each device did something, without a session id."""
    return events(spark, sf_dir).select(
        F.concat(F.lit("device_"), F.col("user_id").cast("string")).alias("device_id"), _millis().alias("ms")
    )


def app_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement scores and session counts as an application would publish them."""
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        _millis().alias("ms"),
        F.when(kind == "view", F.col("value").cast("double")).alias("engagement"),
        F.when(kind == "click", 1).otherwise(0).alias("sessions"),
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes scanned by ad-hoc queries, 1.5 GB for each unit of ``k``."""
    return events(spark, sf_dir).select(
        _millis().alias("ms"), (_k().cast("bigint") * 1_500_000_000).alias("bytes_scanned")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue messages: 1 in 10 sent again 2 s later with the same body, 1 in 50 not parseable."""
    text = lambda c: F.col(c).cast("string")
    copies = F.when(F.col("event_id") % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = events(spark, sf_dir).select(
        "event_id", "user_id", "event_type", _millis().alias("ms"), F.explode(copies).alias("c")
    )
    bad = F.col("event_id") % 50 == 7
    message_id = F.concat(F.lit("m"), text("event_id"), F.lit("_"), text("c"))
    body = F.concat(F.lit('{"event_id":'), text("event_id"), F.lit(',"user_id":'), text("user_id"), F.lit("}"))
    return rows.select(
        message_id.alias("message_id"),
        F.when(F.col("event_type") == "purchase", "analytics")
        .when(F.col("event_type") == "signup", "emails")
        .otherwise("feedback")
        .alias("queue"),
        F.concat(F.lit("g"), text("user_id")).alias("group_id"),
        F.when(bad, message_id).alias("dedup_id"),
        F.when(bad, "{bad").otherwise(body).alias("body"),
        (F.col("ms") + F.col("c") * 2000).alias("sent_ms"),
        F.lit(0).alias("receive_count"),
    )


def late_messages(spark: SparkSession, sf_dir: str, pieces: int = 4, lateness_ms: int = 480_000) -> DataFrame:
    """Messages of which 1 in 20 is sent again after 4, 8 and 12 minutes; ``piece`` numbers the files they arrive in.

    They arrive up to ``lateness_ms`` after they were sent, so a piece holds messages older than some of the piece before.
    """
    rows = messages(spark, sf_dir)
    number = F.regexp_extract("message_id", r"^m(\d+)_0$", 1)
    chain = F.when((number != "") & (number.cast("bigint") % 20 == 3), F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("again", F.explode(chain))
    name = F.when(F.col("again") > 0, F.concat("message_id", F.lit("_again"), F.col("again").cast("string"))).otherwise(F.col("message_id"))
    rows = rows.withColumns({"message_id": name, "sent_ms": F.col("sent_ms") + F.col("again") * 240_000}).drop("again")
    arrival = F.col("sent_ms") + F.pmod(F.xxhash64("message_id"), F.lit(lateness_ms))
    span = rows.agg(F.min("sent_ms").alias("low"), F.max("sent_ms").alias("high")).first()
    step = max(1, ((span["high"] or 0) - (span["low"] or 0)) // pieces)
    piece = F.least(F.floor((arrival - F.lit(span["low"] or 0)) / step), F.lit(pieces - 1))
    return rows.withColumn("piece", piece.cast("int"))


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each message was sent, first received, deleted, or given up after three receives 300 s apart."""
    sent, bad = F.col("sent_ms"), F.col("body") == "{bad"
    return messages(spark, sf_dir).select(
        "queue",
        "message_id",
        "sent_ms",
        (sent + sent % 240_000).alias("received_ms"),
        F.when(~bad, sent + sent % 240_000 + sent % 600_000).alias("deleted_ms"),
        F.when(bad, sent + sent % 240_000 + 900_000).alias("dead_ms"),
    )


def text_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose bodies are whole documents, for the size rule."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("message_id"),
        F.lit("feedback").alias("queue"),
        F.col("source").alias("group_id"),
        F.lit(None).cast("string").alias("dedup_id"),
        F.col("text").alias("body"),
        F.lit(0).cast("bigint").alias("sent_ms"),
        F.lit(0).alias("receive_count"),
    )


def user_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour rows with every nested part; some keys are left out on purpose."""
    return _raw(spark, sf_dir).selectExpr(
        "concat('bhv_', CAST(src_id AS STRING)) AS behavior_id",
        "CAST(user_id AS STRING) AS user_id",
        *_owner("session_id", "device_id"),
        "ms AS timestamp",
        "src AS behavior_type",
        """named_struct('session_completion_rate', k / 100D, 'breathing_sessions_completed', CAST(k % 8 AS BIGINT),
            'technique_effectiveness', CASE WHEN k % 2 = 0 THEN 'steady' END) AS wellness_metrics""",
        """named_struct('preferred_session_times', array('morning', CASE WHEN k % 2 = 0 THEN 'evening' ELSE 'night' END),
            'feature_usage_frequency', map('breathing', CAST(k % 5 AS BIGINT), 'focus', CAST(k % 9 AS BIGINT)),
            'retention_indicators', named_struct('days_since_first_use', user_id % 40)) AS engagement_patterns""",
        """named_struct('notification_settings', map('daily', k % 2 = 0),
            'privacy_settings', map('share', CASE WHEN k % 3 = 0 THEN 'all' ELSE 'none' END)) AS user_preferences""",
        "named_struct('app_version', '1.0.0', 'battery_level', value) AS device_context",
        *_owner("year", "month", "day"),
        HOUR,
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback rows with 0, 1 or 2 attachments."""
    item = "named_struct('type', '{0}', 'filename', concat('shot_', CAST(src_id AS STRING)), 'size', CAST(k * {1} AS BIGINT))"
    one, two = item.format("image", 10), item.format("log", 20)
    return _raw(spark, sf_dir).selectExpr(
        "concat('fb_', CAST(src_id AS STRING)) AS feedback_id",
        *_owner("device_id"),
        "ms AS timestamp",
        "src AS feedback_type",
        "CASE WHEN k % 4 = 0 THEN 'high' ELSE 'low' END AS severity",
        "1D + k % 5 AS user_rating",
        "array('app', src) AS tags",
        f"slice(array({one}, {two}), 1, k % 3) AS attachments",
        """named_struct('current_screen', 'Home', 'performance_metrics',
            named_struct('load_time', value, 'crash_occurred', k % 10 = 9)) AS app_state""",
        "named_struct('status', CASE WHEN k % 2 = 0 THEN 'open' ELSE 'resolved' END) AS processing_status",
        *_owner("year", "month", "day"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with their optional parts."""
    return _raw(spark, sf_dir).where("src = 'purchase'").selectExpr(
        "concat('txn_', CAST(src_id AS STRING)) AS transaction_id",
        *_owner("device_id"),
        "ms AS timestamp",
        "CASE WHEN k % 2 = 0 THEN 'subscription' ELSE 'one_time' END AS transaction_type",
        "value AS amount",
        "'USD' AS currency",
        """CASE WHEN k % 2 = 0 THEN named_struct('plan_type', 'monthly', 'trial_period', k % 4 = 0) END
            AS subscription_info""",
        "CASE WHEN k % 10 = 9 THEN 'refunded' ELSE 'completed' END AS transaction_status",
        "CASE WHEN k % 10 = 9 THEN named_struct('refund_amount', value, 'refund_reason', 'request') END AS refund_info",
        "CASE WHEN k % 5 = 0 THEN named_struct('code', 'WELCOME', 'discount_amount', 1.5D) END AS promo_code",
        "named_struct('tax_rate', 0.25D, 'tax_exempt', k % 7 = 0) AS tax_info",
        "named_struct('receipt_sent', k % 2 = 1) AS receipt_info",
        "named_struct('risk_score', k / 100D) AS risk_assessment",
        *_owner("year", "month", "day"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untyped event form with a string map of properties."""
    return events(spark, sf_dir).select(
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_id"),
        "event_type",
        F.create_map(F.lit("k"), _k().cast("string")).alias("properties"),
        _millis().alias("ms"),
    )


def host_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host metrics in the CSV layout."""
    host = F.concat(F.lit("host=web-0"), (F.col("user_id") % 4).cast("string"))
    return events(spark, sf_dir).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.concat("event_type", F.lit("_usage")).alias("metric_name"),
        F.col("value").alias("value"),
        F.concat(host, F.lit(",k="), _k().cast("string")).alias("tags"),
    )


def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object listing such as a bucket inventory: one object per source event, in four areas."""
    area = (
        F.when(F.col("event_type") == "error", "temp/")
        .when(F.col("event_type") == "signup", "query-results/")
        .when(F.col("event_type") == "view", "processed/")
        .otherwise("data/")
    )
    return events(spark, sf_dir).select(
        F.concat(area, F.lit("obj_"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"),
        (_k().cast("bigint") * 1024).alias("size"),
        F.col("ts").cast("timestamp").alias("modified"),
    )
