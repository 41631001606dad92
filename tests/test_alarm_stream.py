"""Alarm states on a stream against the batch states, windows without data and silent series included."""

import random

import pytest
from pyspark.sql import functions as F

from lakepulse.operators.alarms import MISSING, alarm_states
from lakepulse.streaming import queues
from lakepulse.streaming.alarms import Machine, alarm_state_stream

P = 300_000
T0 = 1_700_000_100_000
DDL = "host string, window_start bigint, value double"


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for host, low, high in (("a", 0, 60), ("b", 5, 30), ("c", 40, 60)):  # b falls silent, c begins late
        rows += [(host, T0 + k * P, rng.choice([1.0, 9.0, 9.0, None])) for k in range(low, high) if k in (low, 59) or rng.random() < 0.6]
    return rows


def batch_states(spark, rows, **kw):
    last = max(w for _, w, _ in rows)
    ends = [(h, last, None) for h in sorted({h for h, _, _ in rows}) if (h, last) not in {(x, w) for x, w, _ in rows}]
    return sorted(map(tuple, alarm_states(spark.createDataFrame(rows + ends, DDL), 300, ">", 5.0, by=["host"], **kw).collect()))


def streamed(spark, tmp_path, pieces, **kw):
    each = lambda piece: spark.createDataFrame(piece, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for piece in pieces:
        each(piece)
        stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "in"))
        states = alarm_state_stream(stream, 300, ">", 5.0, by=["host"], delay="30 minutes", **kw)
        queues.run_to_files(states, str(tmp_path / "out"), str(tmp_path / "cp"))
    return sorted(map(tuple, spark.read.schema(f"{DDL}, breach int, state string").parquet(str(tmp_path / "out")).collect()))


@pytest.mark.parametrize(("missing", "n_periods"), [("missing", 2), ("ignore", 3)])
def test_states_equal_the_batch_over_restarts(spark, tmp_path, missing, n_periods):
    rows = rows_of(3)
    rng = random.Random(1)
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(6) * P)  # up to 25 minutes late
    close = [("a", T0 + 66 * P, 1.0)]  # brings the watermark to the last window
    pieces = [order[:40], order[40:70], order[70:], close]
    got = streamed(spark, tmp_path, [p for p in pieces if p], missing=missing, n_periods=n_periods)
    want = [r for r in batch_states(spark, rows + close, missing=missing, n_periods=n_periods) if r[1] <= T0 + 60 * P]
    assert got == want
    silent = [r for r in got if r[0] == "b" and r[1] > T0 + 29 * P]
    assert len(silent) >= 31 and {r[2] for r in silent} == {None}


@pytest.mark.parametrize("missing", MISSING)
def test_machine_equals_the_batch(spark, missing):
    for seed in range(3):
        rng = random.Random(seed)
        values = [rng.choice([1.0, 9.0, 9.0, None, None]) for _ in range(80)]
        rows = [("a", T0 + k * P, v) for k, v in enumerate(values)]
        for n in (1, 3):
            machine = Machine(">", 5.0, n, missing, [], None)
            assert [machine.step(v) for v in values] == [r[3:] for r in batch_states(spark, rows, missing=missing, n_periods=n)]


def test_one_series_without_keys(spark, tmp_path):
    spark.createDataFrame([(T0, 9.0), (T0 + P, 9.0), (T0 + 3 * P, 1.0)], "window_start bigint, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("window_start bigint, value double").parquet(str(tmp_path / "in"))
    queues.run_to_files(alarm_state_stream(stream, 300, ">", 5.0, 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").select("breach", "state", F.col("value").isNull().alias("e")).collect()
    assert [tuple(r) for r in got] == [(1, "OK", False), (1, "ALARM", False), (None, "OK", True), (0, "OK", False)]


def test_unknown_treatment_is_refused(spark):
    with pytest.raises(ValueError):
        alarm_state_stream(spark.createDataFrame([], DDL), 300, ">", 5.0, 2, missing="other")
