"""Streams against batch results: restarts, duplicates, late rows, failures."""

import json

import pytest
from pyspark.sql import functions as F

from lakepulse.functions.exprs import DAY_MS
from lakepulse.operators.flatten import flatten_events, to_flat
from lakepulse.plans.monitoring import error_rate_series
from lakepulse.sources import fixture, lake, sinks
from lakepulse.sources.schemas import MESSAGES
from lakepulse.streaming import lake as lake_streams
from lakepulse.streaming import queues

BODY = "event_id bigint, user_id bigint"


def land(spark, path, rows, n=1):
    """``rows``: (message_id, queue, group_id, dedup_id, body, sent_ms, receive_count)."""
    spark.createDataFrame(rows, MESSAGES).coalesce(n).write.mode("append").parquet(path)


NOON = 1_700_000_000_000


def message(i, body="{}", queue="q", group="g", dedup=None, at=NOON):
    return (f"m{i}", queue, group, dedup, body, at, 0)


@pytest.fixture
def dirs(tmp_path):
    return lambda name: str(tmp_path / name)


HOUR = 3_600_000


def deduplicated(spark, dirs, batches, **options):
    each = queues.write_once(dirs("out"), **options)
    for rows in batches:
        land(spark, dirs("in"), rows)
        queues.run_batches(queues.read_messages(spark, dirs("in")), dirs("cp"), each)
    return sorted(r.message_id for r in spark.read.schema(MESSAGES).parquet(dirs("out") + "/messages").collect())


@pytest.mark.parametrize("cuts", [[], [1], [1, 2, 3], [2]])
def test_copies_an_hour_apart_are_messages_of_their_own(spark, dirs, cuts):
    rows = [message(i, "same", queue="analytics", at=NOON + i * HOUR) for i in range(4)]
    edges = [0, *cuts, 4]
    got = deduplicated(spark, dirs, [rows[a:b] for a, b in zip(edges, edges[1:], strict=False)])
    assert got == ["m0", "m1", "m2", "m3"]


@pytest.mark.parametrize("cut", [1, 3, 5, 9])
def test_the_interval_runs_from_the_last_message_kept(spark, dirs, cut):
    minute = 60_000
    rows = [message(i, "same", queue="analytics", at=NOON + m * minute) for i, m in enumerate([0, 2, 4, 5, 9, 10, 14, 15, 30])]
    assert deduplicated(spark, dirs, [rows[:cut], rows[cut:]] if cut < 9 else [rows]) == ["m0", "m3", "m5", "m7", "m8"]


def test_a_hot_message_is_kept_once_and_late_copies_remove_nothing(spark, dirs):
    hot = [message(i, "hot", queue="analytics") for i in range(50)]
    late = [message(60, "z", queue="analytics", at=NOON - 2 * HOUR), message(61, "z", queue="analytics"), message(62, "hot", queue="analytics", at=NOON - 1000)]
    assert deduplicated(spark, dirs, [hot, late]) == ["m0", "m60", "m61"]


def test_content_counts_only_where_it_is_on_and_ids_come_first(spark, dirs):
    rows = [
        message(1, "a", dedup="1"), message(2, "a", dedup="2"), message(3, "b", dedup="1"),
        message(4, "a"), message(5, "a"), message(6, "a", queue="analytics"), message(7, "a", queue="analytics"),
        message(8, None, queue="analytics"), message(9, None, queue="analytics"),
    ]
    assert deduplicated(spark, dirs, [rows]) == ["m1", "m2", "m4", "m5", "m6", "m8", "m9"]


def test_receive_limits_by_queue(spark, dirs):
    rows = [message(1, "{bad", queue="once"), message(2, "{bad", queue="twice"), message(3, "{bad")]
    land(spark, dirs("in") + "/first", rows)
    each = queues.settle(dirs("in"), dirs("done"), dirs("dead"), BODY, max_receives={"once": 1, "twice": 2})
    for _ in range(3):
        queues.run_batches(queues.read_messages(spark, dirs("in")), dirs("cp"), each)
    dead = {r.message_id: r.receive_count for r in spark.read.parquet(dirs("dead")).collect()}
    assert dead == {"m1": 1, "m2": 2, "m3": queues.MAX_RECEIVES}


@pytest.mark.parametrize("hot_rows", [None, 5])
def test_order_within_groups_holds_over_epochs(spark, dirs, hot_rows):
    each = queues.write_in_order(dirs("out"), hot_rows)
    rows = [message(i, group=f"g{i % 3 % 2}", at=(i * 7919) % 1000) for i in range(60)]
    land(spark, dirs("in"), rows[:40])
    queues.run_batches(queues.read_messages(spark, dirs("in")), dirs("cp"), each)
    land(spark, dirs("in"), rows[40:])
    queues.run_batches(queues.read_messages(spark, dirs("in")), dirs("cp"), each)
    got = spark.read.parquet(dirs("out")).orderBy("group_id", "epoch", "seq").collect()
    for group in ("g0", "g1"):
        order = [(r.epoch, r.message_id) for r in got if r.group_id == group]
        want = [
            (epoch, m[0])
            for epoch, part in ((0, rows[:40]), (1, rows[40:]))
            for m in sorted((m for m in part if m[2] == group), key=lambda m: (m[5], m[0]))
        ]
        assert order == want


def good(i):
    return json.dumps({"event_id": i, "user_id": i})


def test_failed_messages_return_and_then_die(spark, dirs):
    rows = [message(1, good(1)), message(2, "{bad"), message(3, None), message(4, good(4) + " " * 100), message(5, "")]
    land(spark, dirs("in") + "/first", rows)
    each = queues.settle(dirs("in"), dirs("done"), dirs("dead"), BODY, max_receives=2, max_bytes=60)
    read = lambda p: {r.message_id: r for r in spark.read.parquet(dirs(p)).collect()}
    queues.run_batches(queues.read_messages(spark, dirs("in")), dirs("cp"), each)
    assert set(read("done")) == {"m1"} and {m: r.reason for m, r in read("dead").items()} == {"m4": "too large"}
    for _ in range(3):  # later runs find nothing new once every message is settled
        queues.run_batches(queues.read_messages(spark, dirs("in")), dirs("cp"), each)
    assert set(read("done")) == {"m1"} and read("done")["m1"].event_id == 1
    assert {m: r.receive_count for m, r in read("dead").items()} == {"m2": 2, "m3": 2, "m4": 1, "m5": 2}
    assert spark.read.parquet(dirs("dead")).count() == 4


def test_a_batch_that_runs_again_replaces_its_output(spark, dirs):
    rows = spark.createDataFrame([message(1, good(1)), message(2, "{bad")], MESSAGES)
    each = queues.settle(dirs("in"), dirs("done"), dirs("dead"), BODY)
    each(rows, 0)
    each(rows, 0)
    assert spark.read.parquet(dirs("done")).count() == 1
    assert spark.read.schema(MESSAGES).option("recursiveFileLookup", True).parquet(dirs("in")).count() == 1


def test_size_rule_at_the_limit(spark):
    rows = spark.createDataFrame(
        [message(1, "x" * 262_144), message(2, "x" * 262_145), message(3, "é" * 131_073), message(4, None)], MESSAGES
    )
    got = {r.message_id: (r.bytes, r.rejected) for r in queues.flag_oversize(rows).collect()}
    assert got == {"m1": (262_144, 0), "m2": (262_145, 1), "m3": (262_146, 1), "m4": (None, 0)}


def test_retention_by_queue(spark):
    now = 100 * DAY_MS
    rows = [message(f"{q}{d}", queue=q, at=now - d * DAY_MS + 1) for q in ("analytics", "emails", "other") for d in (4, 5, 7, 8, 14, 15)]
    got = {r.message_id for r in queues.within_retention(spark.createDataFrame(rows, MESSAGES), now).collect()}
    assert got == {"manalytics4", "manalytics5", "manalytics7", "mother4"} | {f"memails{d}" for d in (4, 5, 7, 8, 14)}
    assert queues.within_retention(spark.createDataFrame(rows, MESSAGES)).count() == 0


def test_worker_results_equal_batch(spark, tiny, dirs):
    fixture.messages(spark, tiny).repartition(5).write.parquet(dirs("in"))
    stream = queues.worker_results(queues.read_messages(spark, dirs("in"), files_per_batch=2), BODY)
    queues.run_to_files(stream, dirs("out"), dirs("cp"), ["year", "month", "day"], "json")
    want = queues.worker_results(fixture.messages(spark, tiny), BODY)
    got = spark.read.schema(want.schema).json(dirs("out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_flattening_continues_after_a_restart(spark, tiny, dirs):
    rows = fixture.batches(spark, tiny)
    early = F.col("day") < "10"

    def run():
        stream = lake_streams.flat_stream(lake_streams.read_batch_stream(spark, dirs("in"), files_per_batch=7))
        queues.run_to_files(stream, dirs("out"), dirs("cp"), ["year", "month", "day"])

    sinks.write_json(rows.where(early), dirs("in"))
    run()
    sinks.write_json(rows.where(~early), dirs("in"), mode="append")
    run()
    run()
    want = to_flat(flatten_events(lake.read_batches(spark, dirs("in"))))
    got = spark.read.schema(want.schema).parquet(dirs("out"))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


HTTP = "ms bigint, latency_s double, is_4xx int, is_5xx int"


def test_windows_close_and_late_rows_are_left_out(spark, dirs):
    def run(rows):
        spark.createDataFrame(rows, HTTP).coalesce(1).write.mode("append").parquet(dirs("in"))
        stream = lake_streams.error_rate_stream(spark.readStream.schema(HTTP).parquet(dirs("in")), 300, "10 minutes")
        queues.run_to_files(stream, dirs("out"), dirs("cp"))
        found = spark.read.schema("window_start bigint, value double").parquet(dirs("out")).collect()
        return sorted((r.window_start // 60_000, r.value) for r in found)

    minute = lambda m, bad=0: (m * 60_000, 0.1, bad, 0)
    assert run([minute(0, 1), minute(1), minute(6)]) == []
    # The newest row moves the watermark to minute 10, which closes the first two windows.
    assert run([minute(2), minute(20)]) == [(0, 1 / 3 * 100), (5, 0.0)]
    assert run([minute(3, 1), minute(40)]) == [(0, 1 / 3 * 100), (5, 0.0), (20, 0.0)]


def test_closed_windows_equal_batch(spark, tiny, dirs):
    rows = fixture.http_metrics(spark, tiny)
    rows.write.parquet(dirs("in"))
    stream = lake_streams.error_rate_stream(spark.readStream.schema(HTTP).parquet(dirs("in")))
    queues.run_to_files(stream, dirs("out"), dirs("cp"))
    got = spark.read.schema("window_start bigint, value double").parquet(dirs("out"))
    newest = rows.agg(F.max("ms")).first()[0]
    want = error_rate_series(rows).where(F.col("window_start") + 300_000 <= newest - 600_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_arriving_pieces_land_in_one_pass_and_are_an_epoch_each(spark, tiny):
    from lakepulse.checks import streams
    from lakepulse.streaming import reorder

    landed = spark.read.parquet(streams._arriving(spark, tiny))
    assert sorted(r["piece"] for r in landed.select("piece").distinct().collect()) == list(range(streams.PIECES))
    released = spark.read.parquet(streams._released(spark, tiny, "epochs", reorder.groups_in_order))
    assert released.count() == landed.count() and released.where("late").count() == 0
    assert released.where(f"epoch >= {streams.PIECES}").count() < landed.where(f"piece = {streams.PIECES - 1}").count()
