"""Queue semantics as Structured Streaming jobs over landed message files.

Delivery is at least once, so every sink is idempotent: file sinks commit per micro-batch, and
``foreachBatch`` sinks write each epoch to its own folder and overwrite it when a batch is run again.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepulse.functions.exprs import DAY_MS, HOUR_MS, ms_date
from lakepulse.operators.runs import ordered_runs
from lakepulse.session import written
from lakepulse.sources import schemas
from lakepulse.streaming.keys import CONTENT_QUEUES, DEDUP_MS, dedup_key
from lakepulse.streaming.reorder import judged

# Queue settings.
MAX_BYTES = 262_144
MAX_RECEIVES = 3
RETENTION_DAYS = {"feedback": 14, "emails": 14, "analytics": 7, "testflight": 14}
DEFAULT_RETENTION_DAYS = 4

_SEEN = "queue string, key string, at bigint, epoch bigint, hour bigint"


def read_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.MESSAGES).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process what has landed so far, then stop; the checkpoint remembers what was done."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_to_files(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, file_format: str = "parquet"
) -> None:
    writer = stream.writeStream.format(file_format).outputMode("append").option("checkpointLocation", checkpoint)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.trigger(availableNow=True).start(path).awaitTermination()


def write_once(
    path: str, interval_ms: int = DEDUP_MS, content_queues: Collection[str] = CONTENT_QUEUES
) -> Callable[[DataFrame, int], None]:
    """Epoch sink that stores one message per (queue, key) and interval, below ``path/messages``.

    A message is a copy if a stored one with its key was sent less than ``interval_ms`` before it; a late message also
    if a stored one was sent less than that after it. Messages of a batch are judged in the order they were sent, so
    messages that arrive in order give the same result however they are batched; ``reorder.dedup_in_order`` waits for late
    ones. Copies sent at one time are combined on the map side; a key's distinct times are scanned, not gathered.
    What was stored is remembered below ``path/seen`` by the hour sent, and a batch reads only hours near its own.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        names = batch.columns
        keyed = batch.withColumn("key", dedup_key(content_queues))
        first = F.min_by(F.struct(*names), "message_id").alias("message")
        at_once = written(keyed.groupBy("queue", "key", F.col("sent_ms").alias("at")).agg(first), "copies")
        span = at_once.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
        before = spark.createDataFrame([], _SEEN)
        if epoch and span["low"] is not None:
            low, high = ((span["low"] - interval_ms) // HOUR_MS, (span["high"] + interval_ms) // HOUR_MS)
            before = spark.read.schema(_SEEN).option("basePath", f"{path}/seen").parquet(f"{path}/seen")
            before = before.where((F.col("epoch") < epoch) & F.col("hour").between(low, high))
        kept = written(judged(at_once.where("at IS NOT NULL"), before, interval_ms), "kept")
        stored = at_once.join(kept, ["queue", "key", "at"])
        # A message without a time is no copy of any.
        untimed = at_once.where("at IS NULL")
        stored.unionByName(untimed).select("message.*").write.mode("overwrite").parquet(f"{path}/messages/epoch={epoch}")
        seen = kept.withColumn("hour", F.floor(F.col("at") / HOUR_MS))
        seen.write.mode("overwrite").partitionBy("hour").parquet(f"{path}/seen/epoch={epoch}")

    return each


def write_in_order(path: str, hot_rows: int | None = None) -> Callable[[DataFrame, int], None]:
    """Epoch sink that numbers messages within their group; (epoch, seq) orders a group for good.

    A later epoch only holds messages that arrived later, so no per-group state is kept, and a hot
    group is numbered in parts instead of in one task.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        ordered = ordered_runs(batch, ["queue", "group_id"], "sent_ms", ["message_id"], lambda w: {}, hot_rows=hot_rows)
        numbered = ordered.withColumnRenamed("run_index", "seq").drop("run_length")
        numbered.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return each


def retention_ms(days: dict[str, int] | None = None, default_days: int = DEFAULT_RETENTION_DAYS) -> Column:
    out = None
    for queue, n in (RETENTION_DAYS if days is None else days).items():
        hit = F.col("queue") == queue
        out = F.when(hit, n * DAY_MS) if out is None else out.when(hit, n * DAY_MS)
    default = F.lit(default_days * DAY_MS)
    return default if out is None else out.otherwise(default)


def within_retention(messages: DataFrame, now_ms: int | None = None, days: dict[str, int] | None = None) -> DataFrame:
    """Drop messages older than their queue keeps them, against the batch time or a given time."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms)
    return messages.where(F.col("sent_ms") > now - retention_ms(days))


def oversize(max_bytes: int = MAX_BYTES) -> Column:
    """Never NULL, so that a message without a body is not lost between two filters."""
    return F.coalesce(F.octet_length("body") > max_bytes, F.lit(False))


def flag_oversize(messages: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add the body's bytes and whether the size rule rejects it; write with ``rejected`` as a partition."""
    return messages.withColumns({"bytes": F.octet_length("body"), "rejected": oversize(max_bytes).cast("int")})


def parse_body(messages: DataFrame, fields: str) -> DataFrame:
    """Add ``payload`` from the JSON body, and ``ok``: whether the whole body parsed."""
    parsed = F.from_json(
        "body", f"{fields}, {schemas.CORRUPT} string", {"columnNameOfCorruptRecord": schemas.CORRUPT}
    )
    rows = messages.withColumn("payload", parsed)
    ok = F.col("payload").isNotNull() & F.col(f"payload.{schemas.CORRUPT}").isNull()
    return rows.withColumn("ok", ok).withColumn("payload", F.col("payload").dropFields(schemas.CORRUPT))


def settle(
    landing: str,
    done: str,
    dead: str,
    fields: str,
    max_receives: int | dict[str, int] = MAX_RECEIVES,
    max_bytes: int = MAX_BYTES,
) -> Callable[[DataFrame, int], None]:
    """Epoch sink of a worker: parsed messages are stored, failed ones return or go to dead letters.

    A failed message is landed again with one more receive on its count, so the next trigger picks
    it up; after ``max_receives`` failures, or at once when its body is too large, it is dead. The limit may be given
    for each queue; queues without one have the default.
    """
    limits = max_receives if isinstance(max_receives, dict) else {}
    most = F.lit(MAX_RECEIVES if limits else max_receives)
    for queue, n in limits.items():
        most = F.when(F.col("queue") == queue, n).otherwise(most)

    def each(batch: DataFrame, epoch: int) -> None:
        received = parse_body(batch, fields).withColumn("receive_count", F.col("receive_count") + 1).persist()
        too_big = oversize(max_bytes)
        failed = received.where(~F.col("ok") | too_big).drop("payload", "ok")
        final = (F.col("receive_count") >= most) | too_big
        stored = received.where(F.col("ok") & ~too_big).select(
            "message_id", "queue", "group_id", "sent_ms", "receive_count", "payload.*"
        )
        stored.write.mode("overwrite").parquet(f"{done}/epoch={epoch}")
        reason = F.when(too_big, "too large").otherwise("not parseable")
        failed.where(final).withColumn("reason", reason).write.mode("overwrite").parquet(f"{dead}/epoch={epoch}")
        failed.where(~final).select(*schemas.MESSAGE_COLUMNS).write.mode("overwrite").parquet(f"{landing}/retry-{epoch}")
        received.unpersist()

    return each


def worker_results(messages: DataFrame, fields: str) -> DataFrame:
    """Parsed payloads with the date they are stored under."""
    parsed = parse_body(messages, fields).where("ok")
    d = ms_date("sent_ms")
    return parsed.select(
        "message_id",
        "payload.*",
        F.date_format(d, "yyyy").alias("year"),
        F.date_format(d, "MM").alias("month"),
        F.date_format(d, "dd").alias("day"),
    )
