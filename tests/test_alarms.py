"""Alarm streaks, gaps and queue series."""

import time

import pytest
from pyspark.sql import functions as F

from lakepulse.operators.alarms import alarm_states
from lakepulse.plans import monitoring as m

P = 300_000


def states(spark, values, **kw):
    """``values``: one per window, None where the window holds no data."""
    rows = [(i * P, float(v)) for i, v in enumerate(values) if v is not None]
    series = spark.createDataFrame(rows, "window_start bigint, value double")
    args = {"period_s": 300, "comparison": ">", "threshold": 5.0, "n_periods": 2} | kw
    return [r.state for r in alarm_states(series, **args).orderBy("window_start").collect()]


O, A, N = "OK", "ALARM", "INSUFFICIENT_DATA"  # noqa: E741


@pytest.mark.parametrize(
    ("values", "kw", "want"),
    [
        ([6, 6, 5, 6, 6, 6], {}, [O, A, O, O, A, A]),
        ([6], {}, [O]),
        ([6], {"n_periods": 1}, [A]),
        ([6, None, 6, 6], {}, [O, O, O, A]),
        ([6, None, None, None, 6], {}, [O, O, N, N, O]),
        ([6, None, 6], {"missing": "breaching"}, [O, A, A]),
        ([6, 6, None, 6, 6], {"missing": "notBreaching"}, [O, A, O, O, A]),
        ([6, 6, None, None, 5, None, 6], {"missing": "ignore"}, [O, A, A, A, O, O, O]),
        ([4, 4, 4], {"comparison": "<", "n_periods": 3}, [O, O, A]),
        ([5, 5], {"comparison": ">="}, [O, A]),
        ([5, 5], {"comparison": "<="}, [O, A]),
    ],
)
def test_streaks(spark, values, kw, want):
    assert states(spark, values, **kw) == want


def test_unknown_treatment_is_refused(spark):
    with pytest.raises(ValueError):
        states(spark, [1], missing="maybe")


def test_series_are_kept_apart(spark):
    rows = [("a", 0, 9.0), ("a", P, 9.0), ("b", 0, 9.0), ("b", 2 * P, 9.0)]
    series = spark.createDataFrame(rows, "queue string, window_start bigint, value double")
    got = alarm_states(series, 300, ">", 5.0, 2, by=["queue"]).orderBy("queue", "window_start").collect()
    assert [(r.queue, r.state) for r in got] == [("a", O), ("a", A), ("b", O), ("b", O), ("b", O)]


def log(spark, rows):
    return spark.createDataFrame(
        rows, "queue string, message_id string, sent_ms bigint, received_ms bigint, deleted_ms bigint, dead_ms bigint"
    )


def test_depth_counts_waiting_messages(spark):
    rows = [("q", "1", 0, 10, 70_000, None), ("q", "2", 1_000, 2_000, 3_000, None), ("q", "3", 61_000, None, None, None)]
    got = m.depth_samples(log(spark, rows)).orderBy("window_start").collect()
    assert [(r.window_start, r.depth) for r in got] == [(0, 1), (60_000, 1)]


def test_dead_letters_alarm_at_once_and_stay(spark):
    rows = [("q", "1", 0, 10, None, 200_000), ("q", "2", 0, 10, None, 900_000)]
    got = m.alarm_dead_letters(log(spark, rows)).orderBy("window_start").collect()
    assert [(r.window_start, r.state) for r in got] == [(0, A), (P, A), (2 * P, A), (3 * P, A)]
    assert got[1].value == 1.0


def test_queue_limits(spark):
    rows = [(q, str(i), 0, None, None, None) for q in ("testflight", "emails", "other") for i in range(51)]
    rows += [(q, "late", 3 * P, None, None, None) for q in ("testflight", "emails", "other")]
    got = m.alarm_queue_depth(log(spark, rows)).collect()
    assert {r.queue for r in got if r.state == A} == {"testflight"}


def test_oldest_message(spark):
    rows = [("q", "1", 10_000, None, None, None), ("q", "2", P + 5, P + 6, 3 * P + 1, None), ("q", "3", 20, 30, 2 * P, None)]
    got = m.queue_health(log(spark, rows)).orderBy("window_start").collect()
    want = [(2, P - 20), (3, 2 * P - 20), (2, 3 * P - 10_000), (1, 4 * P - 10_000)]
    assert [(r.depth, r.oldest_age_ms) for r in got] == want
    assert [(r.sent, r.received, r.deleted) for r in got] == [(2, 1, 0), (1, 1, 0), (0, 0, 1), (0, 0, 1)]


def test_error_rate(spark):
    http = spark.createDataFrame(
        [(0, 0.1, 1, 0), (1, 0.1, 0, 1), (2, 0.1, 0, 0), (3, 0.1, 0, 0), (P, 9.0, 0, 0), (None, 1.0, 1, 0)],
        "ms bigint, latency_s double, is_4xx int, is_5xx int",
    )
    assert [r.value for r in m.error_rate_series(http).orderBy("window_start").collect()] == [50.0, 0.0]
    p99 = m.alarm_response_time_p99(http, n_periods=1).orderBy("window_start").collect()
    assert [r.state for r in p99] == [O, A]


def test_windows_far_apart_are_an_error(spark):
    from pyspark.errors import PySparkException

    from lakepulse.operators.alarms import fill_windows

    series = spark.createDataFrame([(0, 1), (1_700_000_000_000, 1)], "window_start bigint, value int")
    with pytest.raises(PySparkException, match="too many empty windows"):
        fill_windows(series, 60, []).count()


def test_health_of_a_backlog_has_a_row_for_each_window(spark):
    """Messages that wait for long spread over no more rows than there are windows."""
    from lakepulse.plans.monitoring import queue_health

    minute, n = 60_000, 400
    rows = [("q", i * minute, i * minute + 10, i * minute + 200 * minute if i % 2 else None, None) for i in range(n)]
    log = spark.createDataFrame(rows, "queue string, sent_ms bigint, received_ms bigint, deleted_ms bigint, dead_ms bigint")
    got = queue_health(log, 60).orderBy("window_start").collect()
    assert len(got) == n - 1 + 200 + 1
    for r in got:
        end = r["window_start"] + minute
        waiting = [s for _, s, _, d, _ in rows if s < end and (d is None or d >= end)]
        assert r["depth"] == len(waiting)
        assert r["oldest_age_ms"] == end - min(waiting)
    plan = queue_health(log, 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(sequence") == 1 and "Join" not in plan


def test_health_is_linear_in_the_windows(spark):
    """A year's windows of one queue, and more: a frame that is computed anew for each row would take minutes."""
    n = 150_000
    rows = spark.range(n).select(
        F.lit("q").alias("queue"),
        F.col("id").cast("string").alias("message_id"),
        (F.col("id") * 300_000).alias("sent_ms"),
        (F.col("id") * 300_000 + 1).alias("received_ms"),
        (F.col("id") * 300_000 + 900_000).alias("deleted_ms"),
        F.lit(None).cast("bigint").alias("dead_ms"),
    )
    began = time.monotonic()
    got = m.queue_health(rows).agg(F.count(F.lit(1)).alias("n"), F.max("oldest_age_ms").alias("age"), F.max("depth").alias("depth")).first()
    assert tuple(got) == (n + 3, 900_000, 3)
    assert time.monotonic() - began < 60
