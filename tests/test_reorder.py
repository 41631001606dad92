"""Event-time order over epochs: any batching of late arrivals gives what one sorted pass gives."""

import random
import resource

import pytest
from pyspark.sql import functions as F

from lakepulse.sources.schemas import MESSAGES
from lakepulse.streaming import reorder

MINUTE = 60_000
NOON = 1_700_000_000_000


def message(i, at, body="same", queue="analytics", group="g"):
    return (f"m{i:03d}", queue, group, None, body, None if at is None else NOON + at, 0)


def run(spark, path, sink, batches, **options):
    for epoch, rows in enumerate(batches):
        sink(path, **options)(spark.createDataFrame(rows, MESSAGES).repartition(2), epoch)
    reorder.flush(spark, sink(path, everything=True, **options), path)
    return spark.read.parquet(f"{path}/messages").collect()


def brute(rows, interval=5 * MINUTE):
    """Judged one by one against the last message stored."""
    out, last = [], {}
    for m in sorted((m for m in rows if m[5] is not None), key=lambda m: (m[5], m[0])):
        key = m[1], m[4]
        if key not in last or m[5] - last[key] >= interval:
            last[key] = m[5]
            out.append(m[0])
    return sorted(out + [m[0] for m in rows if m[5] is None])


def arrivals(rows, lateness, pieces, seed):
    rng = random.Random(seed)
    order = sorted(rows, key=lambda m: (m[5] or NOON) + rng.randrange(lateness))
    cuts = sorted(rng.sample(range(1, len(order)), pieces - 1))
    return [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True)]


@pytest.mark.parametrize(("pieces", "seed"), [(1, 0), (3, 1), (6, 2)])
def test_late_copies_are_judged_by_the_last_one_stored(spark, tmp_path, pieces, seed):
    rng = random.Random(7)
    chains = [message(i, m * MINUTE, "chain") for i, m in enumerate([0, 4, 8, 12, 13, 17, 18, 40, 44, 46])]
    others = [message(100 + i, rng.randrange(60 * MINUTE), rng.choice("ab"), rng.choice(["analytics", "feedback"])) for i in range(60)]
    rows = [*chains, *others, message(900, None), message(901, None)]
    got = run(spark, str(tmp_path), reorder.dedup_in_order, arrivals(rows, 9 * MINUTE, pieces, seed))
    expected = brute([m for m in rows if m[1] == "analytics"]) + [m[0] for m in rows if m[1] == "feedback"]
    assert sorted(r.message_id for r in got) == sorted(expected)


def test_state_expires_and_old_epochs_are_deleted(spark, tmp_path):
    each = reorder.dedup_in_order(str(tmp_path), delay_ms=MINUTE)
    for epoch in range(5):
        rows = [message(10 * epoch + k, epoch * 30 * MINUTE + k * 2 * MINUTE, f"b{k}") for k in range(8)]
        each(spark.createDataFrame(rows, MESSAGES), epoch)
    held = sorted(x.name for x in (tmp_path / "state").iterdir())
    assert held == ["epoch=3", "epoch=4"]
    newest = NOON + 4 * 30 * MINUTE + 14 * MINUTE
    stored = spark.read.parquet(str(tmp_path / "state/epoch=4/stored")).collect()
    assert stored and all(newest - 6 * MINUTE < r["at"] <= newest for r in stored)
    assert [r["sent_ms"] for r in spark.read.parquet(str(tmp_path / "state/epoch=4/waiting")).collect()] == [newest]


def test_an_epoch_that_runs_again_replaces_its_output(spark, tmp_path):
    each = reorder.dedup_in_order(str(tmp_path), delay_ms=MINUTE)
    batches = [spark.createDataFrame([message(10 * e + k, (7 * e + k) * MINUTE) for k in range(9)], MESSAGES) for e in range(3)]
    for epoch, batch in enumerate(batches):
        each(batch, epoch)
        first = sorted(r.message_id for r in spark.read.parquet(f"{tmp_path}/messages").collect())
        each(batch, epoch)
        assert sorted(r.message_id for r in spark.read.parquet(f"{tmp_path}/messages").collect()) == first


def test_messages_behind_the_watermark_are_not_lost(spark, tmp_path):
    batches = [[message(1, 0), message(2, 60 * MINUTE)], [message(3, 30 * MINUTE), message(4, 46 * MINUTE), message(5, 61 * MINUTE)]]
    got = run(spark, str(tmp_path), reorder.dedup_in_order, batches, delay_ms=10 * MINUTE)
    assert sorted(r.message_id for r in got) == ["m001", "m002", "m003", "m004"]


def test_a_million_times_of_one_key_are_scanned(spark):
    """Nothing of a key is gathered: Python's memory doesn't follow the number of times."""
    times = spark.range(1_000_000).select(F.lit("q").alias("queue"), F.lit("k").alias("key"), (F.col("id") * 100).alias("at"))
    stored = spark.createDataFrame([("q", "k", -1000), ("q", "k", 50_000_000)], "queue string, key string, at bigint")
    got = [r["at"] for r in reorder.judged(times, stored, 300_000).orderBy("at").collect()]
    low = [a for a in range(299_000, 50_000_000, 300_000) if a <= 49_700_000]
    assert got[: len(low)] == low and min(b - a for a, b in zip(got, got[1:], strict=False)) >= 300_000
    assert all(abs(a - 50_000_000) >= 300_000 for a in got) and got[len(low)] == 50_300_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 2_000_000


@pytest.mark.parametrize(("pieces", "seed", "hot_rows"), [(1, 0, None), (4, 1, None), (4, 2, 5)])
def test_late_messages_of_a_group_get_their_place(spark, tmp_path, pieces, seed, hot_rows):
    rng = random.Random(seed)
    rows = [message(i, rng.randrange(40 * MINUTE), str(i), group=f"g{i % 3 % 2}") for i in range(80)]
    got = run(spark, str(tmp_path), reorder.groups_in_order, arrivals(rows, 9 * MINUTE, pieces, seed), hot_rows=hot_rows)
    assert not any(r.late for r in got)
    for group in ("g0", "g1"):
        order = [r.message_id for r in sorted(got, key=lambda r: (r.epoch, r.seq)) if r.group_id == group]
        assert order == [m[0] for m in sorted((m for m in rows if m[2] == group), key=lambda m: (m[5], m[0]))]


def test_a_group_message_behind_the_watermark_is_marked(spark, tmp_path):
    batches = [[message(1, 0), message(2, 60 * MINUTE)], [message(3, 30 * MINUTE), message(4, 55 * MINUTE)]]
    got = {r.message_id: (r.epoch, r.late) for r in run(spark, str(tmp_path), reorder.groups_in_order, batches, delay_ms=10 * MINUTE)}
    assert got == {"m001": (0, False), "m003": (1, True), "m002": (2, False), "m004": (2, False)}
