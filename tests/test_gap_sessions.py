"""Sessions by gaps: a stream in any order of arrival gives the batch's sessions, and these the batch's active ones."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lakepulse.functions.exprs import HOUR_MS
from lakepulse.plans import engagement
from lakepulse.streaming import queues
from lakepulse.streaming.sessions import active_sessions, gap_sessions

GAP, T0 = 1_800_000, 1_705_300_000_000
DDL = "device string, ms bigint"


def rows_of(seed, n=300):
    rng = random.Random(seed)
    out = [(rng.choice(["hot"] * 3 + ["a", "b", "c", None]), T0 + rng.randrange(40 * HOUR_MS)) for _ in range(n)]
    out += [(d, ms + k) for d, ms in out[:20] for k in (GAP - 1, GAP, GAP + 1, 0)]  # at the edge of the gap, and ties
    return [*out, ("a", None)]


def brute(rows):
    out = []
    for device in {d for d, _ in rows} - {None}:
        times = sorted(ms for d, ms in rows if d == device and ms is not None)
        own = [times[0]]
        for a, b in zip(times, times[1:], strict=False):
            if b - a > GAP:
                out.append((device, own[0], own[-1], len(own)))
                own = []
            own.append(b)
        out.append((device, own[0], own[-1], len(own)))
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("device", "start_ms", "last_ms", "events").collect())


@pytest.mark.parametrize("seed", range(3))
def test_batch_sessions_equal_brute_force(spark, seed):
    rows = rows_of(seed)
    assert collected(gap_sessions(spark.createDataFrame(rows, DDL).repartition(3), ["device"])) == brute(rows)


@pytest.mark.parametrize("pieces", [1, 5])
def test_a_stream_merges_sessions_in_any_order_of_arrival(spark, tmp_path, pieces):
    rows = rows_of(7)
    rng = random.Random(pieces)
    order = sorted(rows, key=lambda r: (r[1] or T0) + rng.randrange(2 * HOUR_MS))  # up to two hours late
    cuts = [order[k * len(order) // pieces : (k + 1) * len(order) // pieces] for k in range(pieces)]
    for piece in [*cuts, [("end", T0 + 80 * HOUR_MS)]]:
        spark.createDataFrame(piece, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "in"))
        sessions = gap_sessions(stream, ["device"], delay="3 hours", longest=F.max(F.length("device")))
        queues.run_to_files(sessions, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert collected(spark.read.parquet(str(tmp_path / "out"))) == brute(rows)


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    for piece in ([("a", T0)], [("b", T0 + 9 * HOUR_MS)], [("a", T0 + 60_000)], [("b", T0 + 20 * HOUR_MS)]):
        spark.createDataFrame(piece, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        queues.run_to_files(gap_sessions(spark.readStream.schema(DDL).parquet(str(tmp_path / "in")), ["device"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = collected(spark.read.schema("device string, start_ms bigint, last_ms bigint, events bigint").parquet(str(tmp_path / "out")))
    assert got == [("a", T0, T0, 1), ("b", T0 + 9 * HOUR_MS, T0 + 9 * HOUR_MS, 1)]


@pytest.mark.parametrize(("every", "within"), [(HOUR_MS, HOUR_MS), (600_000, HOUR_MS), (HOUR_MS, GAP), (HOUR_MS, 3 * HOUR_MS)])
def test_active_sessions_equal_brute_force(spark, every, within):
    rows = rows_of(5, n=80)
    sessions = gap_sessions(spark.createDataFrame(rows, DDL), ["device"])
    got = {r.at_ms: r.active_sessions for r in active_sessions(sessions, every_ms=every, within_ms=within).collect()}
    want, first = {}, T0 // every * every
    for at in range(first, first + 50 * HOUR_MS, every):
        n = sum(any(d == device and at - within < ms <= at and lo <= ms <= hi for d, ms in rows if ms) for device, lo, hi, _ in brute(rows))
        if n:
            want[at] = n
    assert got == want


def test_active_sessions_equal_the_engagement_of_that_hour(spark, flat_of):
    """Where each session id stands for one session by gaps, the batch score counts the same sessions."""
    rows = rows_of(9, n=120)
    ids = brute(rows)
    named = [
        {"device_id": d, "session_id": f"{d}-{lo}", "at": datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None).isoformat(), "event_timestamp": str(ms)}
        for d, ms in rows if d and ms
        for device, lo, hi, _ in ids if device == d and lo <= ms <= hi
    ]
    counts = {r.at_ms: r.active_sessions for r in active_sessions(gap_sessions(spark.createDataFrame(rows, DDL), ["device"])).collect()}
    for k in (5, 17, 30):
        at = (T0 // HOUR_MS + k) * HOUR_MS
        batch = engagement.session_based(flat_of(named), datetime.fromtimestamp(at / 1000, UTC).replace(tzinfo=None)).first()
        assert batch.active_sessions == counts.get(at, 0)


def test_a_gap_beyond_the_time_looked_back_is_refused(spark):
    with pytest.raises(ValueError):
        active_sessions(spark.createDataFrame([], "start_ms bigint, last_ms bigint"), within_ms=GAP - 1)
