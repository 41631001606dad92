"""Event-time order for queue jobs: messages wait until the watermark passes them, and what must be remembered expires.

The watermark of an epoch is the newest send time so far less a delay. What it has passed is released in the order sent,
however it arrived; the rest waits. State is a written table for each epoch, ``<path>/state/epoch=N``: the watermark, the
messages that wait, and what a sink remembers. An epoch reads the state of the one before and only ever writes its own, so
one that runs again replaces its output. Older state is deleted, so it holds no more than about delay and interval.

Messages that arrive behind the watermark are late: they are released at once, in the order sent among themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.operators.runs import ordered_runs
from lakepulse.session import exists, written
from lakepulse.sources import schemas
from lakepulse.streaming.keys import CONTENT_QUEUES, DEDUP_MS, dedup_key

DELAY_MS = 600_000
_KEYS = ["queue", "key"]
_REMEMBERED = "queue string, key string, at bigint"


def _scan(interval_ms: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by queue, key and time; one row of memory is enough."""
        held, last = None, None
        for batch in batches:
            keys = list(zip(batch.column("queue").to_pylist(), batch.column("key").to_pylist(), strict=True))
            times = zip(*(batch.column(c).to_pylist() for c in ("at", "before", "after")), strict=True)
            keep = []
            for key, (at, before, after) in zip(keys, times, strict=True):
                if key != held:
                    held, last = key, None
                copy = any(x is not None and abs(at - x) < interval_ms for x in (last, before, after))
                if not copy:
                    last = at
                keep.append(not copy)
            yield batch.select(["queue", "key", "at"]).filter(pa.array(keep, pa.bool_()))

    return scan


def judged(times: DataFrame, stored: DataFrame, interval_ms: int) -> DataFrame:
    """Those of the distinct send times ``queue, key, at`` at which a message is no copy.

    Times are judged in order. One is a copy if less than ``interval_ms`` lies between it and one taken before, or one
    ``stored`` earlier. Nothing of a key is gathered: running windows find the neighbours that are stored, and a scan over
    the sorted rows remembers the last time taken.
    """
    both = times.select(*_KEYS, "at", F.lit(True).alias("new")).unionByName(stored.select(*_KEYS, "at", F.lit(False).alias("new")))
    known = F.last(F.when(~F.col("new"), F.col("at")), ignorenulls=True)
    of_key = Window.partitionBy(*_KEYS)
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("after", known.over(so_far(of_key.orderBy(F.desc("at"), "new"))))
    rows = rows.withColumn("before", known.over(so_far(of_key.orderBy("at", "new")))).where("new").drop("new")
    return rows.sortWithinPartitions(*_KEYS, "at").mapInArrow(_scan(interval_ms), _REMEMBERED)


@dataclass
class Released:
    """What an epoch hands on: ``rows`` with ``late`` added, and the watermark before and now (None without messages)."""

    rows: DataFrame
    before: int | None
    watermark: int | None


class Reorder:
    """Holds messages with a time (``sent_ms``) until the watermark passes them; those without a time pass at once."""

    def __init__(self, path: str, delay_ms: int = DELAY_MS) -> None:
        self.path, self.delay_ms = path, delay_ms

    def state(self, epoch: int, name: str) -> str:
        return f"{self.path}/state/epoch={epoch}/{name}"

    def remembered(self, spark: SparkSession, epoch: int, name: str, schema: str) -> DataFrame:
        """A table of the epoch before; empty if there is none."""
        path = self.state(epoch - 1, name)
        if epoch and exists(spark, path):
            return spark.read.schema(schema).parquet(path)
        return spark.createDataFrame([], schema)

    def remember(self, df: DataFrame, epoch: int, name: str) -> None:
        df.write.mode("overwrite").parquet(self.state(epoch, name))

    def take(self, batch: DataFrame, epoch: int, everything: bool = False) -> Released:
        """Release what the batch brings the watermark past (or all), and keep the rest for the next epoch."""
        spark = batch.sparkSession
        mark = self.remembered(spark, epoch, "watermark", "ms bigint").first()
        before = mark["ms"] if mark else None
        waiting = self.remembered(spark, epoch, "waiting", schemas.MESSAGES)
        new = batch.select(*schemas.MESSAGE_COLUMNS)
        late = F.coalesce(F.col("sent_ms") <= F.lit(before).cast("bigint"), F.lit(False))
        rows = written(new.withColumn("late", late).unionByName(waiting.withColumn("late", F.lit(False))), "arrived")
        newest = rows.agg(F.max("sent_ms").alias("ms")).first()["ms"]
        marks = [m for m in (before, None if newest is None else newest - (0 if everything else self.delay_ms)) if m is not None]
        watermark = max(marks, default=None)
        passed = F.coalesce(F.col("sent_ms") <= F.lit(watermark).cast("bigint"), F.col("sent_ms").isNull())
        self.remember(rows.where(~passed).drop("late"), epoch, "waiting")
        self.remember(spark.createDataFrame([(watermark,)], "ms bigint"), epoch, "watermark")
        return Released(rows.where(passed), before, watermark)

    def forget(self, spark: SparkSession, epoch: int) -> None:
        """Delete state that no epoch reads again: an epoch that runs once more needs the one before it."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/epoch={epoch - 2}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dedup_in_order(
    path: str, interval_ms: int = DEDUP_MS, delay_ms: int = DELAY_MS, content_queues: Collection[str] = CONTENT_QUEUES, everything: bool = False
) -> Callable[[DataFrame, int], None]:
    """Epoch sink that stores one message per (queue, key) and interval, below ``path/messages``, in the order sent.

    Messages are judged once the watermark has passed them, so arrival and batches make no difference as long as no message
    is later than ``delay_ms``. A message is a copy if it was sent less than ``interval_ms`` after the last stored one of
    its key; of those sent at one time the smallest ``message_id`` counts. A late message is a copy if a remembered one
    lies within the interval on either side. A message without a time is no copy of any. Remembered are the times stored
    within ``interval_ms`` before the watermark; older ones can't meet what is still to come. ``everything`` releases all
    that waits, at the end of a stream: run an empty batch with it.
    """
    order = Reorder(path, delay_ms)

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        released = order.take(batch, epoch, everything)
        keyed = released.rows.withColumn("key", dedup_key(content_queues))
        first = F.min_by(F.struct(*schemas.MESSAGE_COLUMNS), "message_id").alias("message")
        timed = keyed.where("sent_ms IS NOT NULL")
        at_once = written(timed.groupBy(*_KEYS, F.col("sent_ms").alias("at")).agg(first), "copies")
        stored = order.remembered(spark, epoch, "stored", _REMEMBERED)
        kept = written(judged(at_once, stored, interval_ms), "kept")
        untimed = keyed.where("sent_ms IS NULL").select(*schemas.MESSAGE_COLUMNS)
        found = at_once.join(kept, [*_KEYS, "at"]).select("message.*").unionByName(untimed)
        found.write.mode("overwrite").parquet(f"{path}/messages/epoch={epoch}")
        fresh = F.lit(True) if released.watermark is None else F.col("at") > released.watermark - interval_ms
        order.remember(stored.unionByName(kept).where(fresh), epoch, "stored")
        order.forget(spark, epoch)

    return each


def groups_in_order(path: str, delay_ms: int = DELAY_MS, hot_rows: int | None = None, everything: bool = False) -> Callable[[DataFrame, int], None]:
    """Epoch sink that releases the messages of a group in the order sent, below ``path/messages``: (epoch, seq) is that order.

    A message that arrives within ``delay_ms`` gets its place, though a newer one came in an earlier epoch. A later one is
    ``late``: it is numbered in the epoch it arrives in. Messages without a time come first in theirs. A hot group is
    numbered in parts. Ties in time go by ``message_id``.
    """
    order = Reorder(path, delay_ms)

    def each(batch: DataFrame, epoch: int) -> None:
        released = order.take(batch, epoch, everything)
        ordered = ordered_runs(released.rows, ["queue", "group_id"], "sent_ms", ["message_id"], lambda w: {}, hot_rows=hot_rows)
        numbered = ordered.withColumnRenamed("run_index", "seq").drop("run_length")
        numbered.write.mode("overwrite").parquet(f"{path}/messages/epoch={epoch}")
        order.forget(batch.sparkSession, epoch)

    return each


def flush(spark: SparkSession, each: Callable[[DataFrame, int], None], path: str) -> None:
    """Run a sink made with ``everything`` on an empty batch behind the last epoch below ``path``."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    store = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(fs_path)] if store.exists(fs_path) else []
    last = max((int(n.split("=")[1]) for n in names), default=-1)
    each(spark.createDataFrame([], schemas.MESSAGES), last + 1)
