"""Streaming jobs: land the input, run to the end of what has landed, read the sink."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.checks.base import HTTP, MS, check, rounded, with_flat, with_messages
from lakepulse.checks.lake import DAY, LANDED, landed_batches
from lakepulse.checks.monitoring import alarm, window
from lakepulse.functions.exprs import HOUR_MS, round_half_up, to_ms
from lakepulse.operators.alarms import alarm_states
from lakepulse.session import scratch
from lakepulse.sources import fixture
from lakepulse.sources.fixture import AS_OF
from lakepulse.sources.schemas import DAILY
from lakepulse.sources.schemas import MESSAGES as MESSAGE_SCHEMA
from lakepulse.sources.sinks import land_once
from lakepulse.streaming import lake as lake_streams
from lakepulse.streaming import queues, reorder
from lakepulse.streaming.alarms import alarm_state_stream
from lakepulse.streaming.sessions import active_sessions, gap_sessions

BODY = "event_id bigint, user_id bigint"


def _landed(spark, sf, name):
    rows = getattr(fixture, name)
    return land_once(spark, LANDED, (name, "stream", sf), lambda path: rows(spark, sf).write.parquet(f"{path}/in"))


def _stream(spark, sf, name="messages"):
    return queues.read_messages(spark, _landed(spark, sf, name))


def _to_files(spark, name, stream, keys=None):
    path = scratch(spark, name)
    queues.run_to_files(stream, path, scratch(spark, f"{name}-checkpoint"), keys)
    return path


PIECES = 4


def _arriving(spark, sf):
    """The messages by the piece they arrive in, landed in one pass."""
    write = lambda path: fixture.late_messages(spark, sf, PIECES).write.partitionBy("piece").parquet(path)
    return land_once(spark, LANDED, ("late-messages", "stream", sf), write)


def _released(spark, sf, name, sink):
    """What a sink releases of the arriving messages, an epoch for each piece, with the rest of what waits at the end."""
    path, checkpoint, arrived = (scratch(spark, f"{name}{part}") for part in ("", "-checkpoint", "-in"))
    pieces = spark.read.schema(f"{MESSAGE_SCHEMA}, piece int").parquet(_arriving(spark, sf))
    for piece in range(PIECES):  # one after the other: what lands between two runs is one epoch, of any number of files
        pieces.where(F.col("piece") == piece).drop("piece").write.parquet(f"{arrived}/{piece}")
        queues.run_batches(queues.read_messages(spark, arrived), checkpoint, sink(path))
    reorder.flush(spark, sink(path, everything=True), path)
    return f"{path}/messages"


# Messages sent once more after 4, 8 and 12 minutes.
LATE = """
, late AS (
  SELECT * REPLACE (CASE WHEN a = 0 THEN message_id ELSE message_id || '_again' || a END AS message_id, sent_ms + a * 240000 AS sent_ms)
  FROM (SELECT *, unnest(CASE WHEN event_id % 20 = 3 AND message_id LIKE '%\\_0' ESCAPE '\\' THEN [0, 1, 2, 3] ELSE [0] END) AS a FROM messages)
)"""


@check(
    "stream_content_dedup",
    with_messages(f"""{LATE}
, ordered AS (
  SELECT *, coalesce(dedup_id, CASE WHEN queue = 'analytics' THEN sha256(body) END, message_id) AS key,
    row_number() OVER (PARTITION BY queue, key ORDER BY sent_ms, message_id) AS n
  FROM late
), walk AS (
  SELECT queue, key, n, message_id, sent_ms AS last, true AS stored FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.queue, o.key, o.n, o.message_id, CASE WHEN o.sent_ms - w.last >= 300000 THEN o.sent_ms ELSE w.last END,
    o.sent_ms - w.last >= 300000
  FROM walk w JOIN ordered o ON o.queue = w.queue AND o.key = w.key AND o.n = w.n + 1
) SELECT o.message_id, o.queue, o.group_id, o.dedup_id, o.body, o.sent_ms
  FROM ordered o JOIN walk w USING (queue, key, n) WHERE w.stored""").replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(spark, sf):
    back = spark.read.schema(f"{MESSAGE_SCHEMA}, epoch bigint").parquet(_released(spark, sf, "dedup", reorder.dedup_in_order))
    return back.select("message_id", "queue", "group_id", "dedup_id", "body", "sent_ms")


@check(
    "stream_group_order",
    with_messages(f"""{LATE}
SELECT queue, group_id, message_id, row_number() OVER (PARTITION BY queue, group_id ORDER BY sent_ms, message_id) AS seq, false AS late
  FROM late"""),
)
def _(spark, sf):
    schema = "queue string, group_id string, message_id string, seq bigint, late boolean, epoch bigint"
    rows = spark.read.schema(schema).parquet(_released(spark, sf, "ordered", reorder.groups_in_order))
    place = F.row_number().over(Window.partitionBy("queue", "group_id").orderBy("epoch", "seq"))
    return rows.select("queue", "group_id", "message_id", place.alias("seq"), "late")


@check(
    "stream_dead_letter",
    with_messages("""
SELECT message_id, queue, CASE WHEN body <> '{bad' THEN 'done' ELSE 'dead' END AS outcome,
    CASE WHEN body <> '{bad' THEN 1 ELSE 3 END AS receive_count
  FROM messages"""),
)
def _(spark, sf):
    landing, done, dead = (scratch(spark, f"letters-{n}") for n in ("in", "done", "dead"))
    fixture.messages(spark, sf).write.parquet(f"{landing}/in")
    each, checkpoint = queues.settle(landing, done, dead, BODY), scratch(spark, "letters-checkpoint")
    for _ in range(queues.MAX_RECEIVES):
        queues.run_batches(queues.read_messages(spark, landing), checkpoint, each)
    outcomes = [
        spark.read.schema("message_id string, queue string, receive_count int, epoch bigint")
        .parquet(path)
        .drop("epoch")
        .withColumn("outcome", F.lit(name))
        for name, path in (("done", done), ("dead", dead))
    ]
    return outcomes[0].unionByName(outcomes[1])


@check(
    "stream_retention",
    with_messages(f"""
SELECT queue, message_id FROM messages
  WHERE sent_ms > {to_ms(AS_OF)} - 86400000 * CASE queue WHEN 'analytics' THEN 7 ELSE 14 END"""),
)
def _(spark, sf):
    path = _to_files(spark, "retained", queues.within_retention(_stream(spark, sf), to_ms(AS_OF)))
    return spark.read.schema("queue string, message_id string").parquet(path)


@check(
    "stream_max_size",
    """SELECT 'd' || doc_id AS message_id, strlen(text) AS bytes, CAST(strlen(text) > 16384 AS INTEGER) AS rejected
  FROM documents""",
)
def _(spark, sf):
    sized = queues.flag_oversize(_stream(spark, sf, "text_messages"), 16_384).select("message_id", "bytes", "rejected")
    path = _to_files(spark, "sized", sized, ["rejected"])
    return spark.read.schema("message_id string, bytes int, rejected int").parquet(path)


@check(
    "stream_worker_sink",
    with_messages("""
, t AS (SELECT *, make_timestamp(sent_ms * 1000) AS sent_at FROM messages WHERE body <> '{bad')
SELECT message_id, event_id, user_id, strftime(sent_at, '%Y') AS year, strftime(sent_at, '%m') AS month, strftime(sent_at, '%d') AS day
  FROM t"""),
)
def _(spark, sf):
    path = _to_files(spark, "worker", queues.worker_results(_stream(spark, sf), BODY), DAY)
    return spark.read.schema(f"message_id string, {BODY}, {DAILY}").parquet(path)


@check(
    "stream_flatten",
    with_flat("""
SELECT event_id, device_id, session_id, event_type, event_timestamp, danger_level, probability_level, response, focus,
    duration, year, month, day
  FROM flat"""),
)
def _(spark, sf):
    stream = lake_streams.flat_stream(lake_streams.read_batch_stream(spark, landed_batches(spark, sf)))
    path = _to_files(spark, "flat", stream, DAY)
    columns = (
        "event_id string, device_id string, session_id string, event_type string, event_timestamp string, "
        "danger_level string, probability_level string, response string, focus string, duration double"
    )
    return spark.read.schema(f"{columns}, {DAILY}").parquet(path)


# A window is final once the newest row is ten minutes past its end.
CLOSED = f"""WITH {HTTP}, series AS (
  SELECT {window('ms', 300)}, CAST(sum(is_4xx + is_5xx) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0e0 AS value
  FROM http GROUP BY 1 HAVING window_start + 300000 <= (SELECT max(ms) FROM http) - 600000)"""


@check("stream_alarm_window", alarm(CLOSED, 300, "value > 5", 2))
def _(spark, sf):
    landed = _landed(spark, sf, "http_metrics")
    columns = "ms bigint, latency_s double, is_4xx int, is_5xx int"
    stream = spark.readStream.schema(columns).option("recursiveFileLookup", True).parquet(landed)
    path = _to_files(spark, "windows", lake_streams.error_rate_stream(stream))
    series = spark.read.schema("window_start bigint, value double").parquet(path)
    return alarm_states(series, 300, ">", 5.0, 2).withColumn("value", round_half_up("value", 6))


# Each host has a row for every closed window from its own first to the last of any host.
HOSTS = f"""WITH requests AS (
  SELECT {MS} AS ms, 'web-' || (user_id % 4) AS host, CAST(event_type = 'error' AS INTEGER) AS failed FROM events
), series AS (
  SELECT host, {window('ms', 300)}, CAST(sum(failed) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0e0 AS value
  FROM requests GROUP BY 1, 2 HAVING window_start + 300000 <= (SELECT max(ms) FROM requests) - 600000
), spine AS (
  SELECT host, unnest(range(min(window_start), (SELECT max(window_start) FROM series) + 1, 300000)) AS window_start FROM series GROUP BY host
), filled AS (SELECT *, CAST(value > 5 AS INTEGER) AS breach FROM spine LEFT JOIN series USING (host, window_start))
SELECT host, window_start, {rounded('value', 6)} AS value, breach,
    CASE WHEN sum(breach) OVER w = 2 THEN 'ALARM' WHEN count(breach) OVER w = 0 THEN 'INSUFFICIENT_DATA' ELSE 'OK' END AS state
  FROM filled WINDOW w AS (PARTITION BY host ORDER BY window_start ROWS 1 PRECEDING)"""


@check("stream_alarm_states", HOSTS)
def _(spark, sf):
    landed = _landed(spark, sf, "host_requests")
    stream = spark.readStream.schema("ms bigint, host string, is_4xx int, is_5xx int").option("recursiveFileLookup", True).parquet(landed)
    closed = _to_files(spark, "closed", lake_streams.error_rate_stream(stream, by=["host"]))
    series = spark.readStream.schema("host string, window_start bigint, value double").parquet(closed)
    states = _to_files(spark, "states", alarm_state_stream(series, 300, ">", 5.0, 2, by=["host"]))
    found = spark.read.schema("host string, window_start bigint, value double, breach int, state string").parquet(states)
    return found.withColumn("value", round_half_up("value", 6))


SESSIONS = f"""WITH src AS (SELECT 'device_' || user_id AS device_id, {MS} AS ms FROM events WHERE user_id IS NOT NULL),
cut AS (
  SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY device_id ORDER BY ms) > 3600000, true) AS begins FROM src
),
numbered AS (SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY device_id ORDER BY ms) AS n FROM cut),
closed AS (
  SELECT device_id, n, min(ms) AS start_ms, max(ms) AS last_ms, count(*) AS events FROM numbered GROUP BY device_id, n
  HAVING max(ms) + 3600000 <= (SELECT max(ms) FROM src) - 600000
)"""


def _gap_sessions(spark, sf):
    stream = spark.readStream.schema("device_id string, ms bigint").option("recursiveFileLookup", True).parquet(_landed(spark, sf, "activity"))
    path = _to_files(spark, "sessions", gap_sessions(stream, ["device_id"], gap_ms=HOUR_MS))
    return spark.read.schema("device_id string, start_ms bigint, last_ms bigint, events bigint").parquet(path)


@check("stream_gap_sessions", f"{SESSIONS} SELECT device_id, start_ms, last_ms, events FROM closed")
def _(spark, sf):
    return _gap_sessions(spark, sf)


@check(
    "stream_active_sessions",
    f"""{SESSIONS}, rows_of AS (SELECT device_id, n, ms FROM numbered JOIN closed USING (device_id, n)),
moments AS (SELECT device_id, n, (ms + 3599999) // 3600000 * 3600000 AS at_ms FROM rows_of)
SELECT at_ms, count(DISTINCT (device_id, n)) AS active_sessions FROM moments GROUP BY at_ms""",
)
def _(spark, sf):
    return active_sessions(_gap_sessions(spark, sf), gap_ms=HOUR_MS)
