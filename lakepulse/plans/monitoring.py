"""Service metrics and the alarms on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.functions.exprs import exact_mean, ratio
from lakepulse.operators.alarms import alarm_states, fill_windows, window_series

# Alarm thresholds.
ERROR_RATE_PERCENT = 5.0
RESPONSE_P99_SECONDS = 3.0
ENGAGEMENT_SCORE = 50.0
SCAN_BYTES = 107_374_182_400
QUEUE_DEPTH = {"feedback": 100, "emails": 500, "analytics": 1000, "testflight": 50}


def error_rate_series(http: DataFrame, period_s: int = 300) -> DataFrame:
    sums = window_series(
        http, "ms", period_s, [], failed=F.sum(F.col("is_4xx") + F.col("is_5xx")), requests=F.count(F.lit(1))
    )
    return sums.select("window_start", (ratio("failed", "requests", digits=None) * 100.0).alias("value"))


def alarm_error_rate(http: DataFrame, threshold: float = ERROR_RATE_PERCENT, n_periods: int = 2) -> DataFrame:
    return alarm_states(error_rate_series(http), 300, ">", threshold, n_periods)


def alarm_response_time_p99(http: DataFrame, threshold: float = RESPONSE_P99_SECONDS, n_periods: int = 2) -> DataFrame:
    series = window_series(http, "ms", 300, [], value=F.percentile_approx("latency_s", 0.99))
    return alarm_states(series, 300, ">", threshold, n_periods)


def alarm_low_engagement(app: DataFrame, threshold: float = ENGAGEMENT_SCORE, n_periods: int = 4) -> DataFrame:
    series = window_series(app.where(F.col("engagement").isNotNull()), "ms", 900, [], value=exact_mean("engagement"))
    return alarm_states(series, 900, "<", threshold, n_periods, missing="notBreaching")


def alarm_scan_cost(queries: DataFrame, threshold: float = SCAN_BYTES, n_periods: int = 2) -> DataFrame:
    series = window_series(queries, "ms", 300, [], value=F.sum("bytes_scanned"))
    return alarm_states(series, 300, ">", threshold, n_periods)


def dashboard_series(http: DataFrame, app: DataFrame, period_s: int = 300) -> DataFrame:
    """Requests, latency, errors, engagement and sessions per window."""
    api = window_series(
        http,
        "ms",
        period_s,
        [],
        requests=F.count(F.lit(1)),
        latency_avg=exact_mean("latency_s"),
        latency_p99=F.percentile_approx("latency_s", 0.99),
        errors_4xx=F.sum("is_4xx"),
        errors_5xx=F.sum("is_5xx"),
    )
    usage = window_series(
        app, "ms", period_s, [], engagement_avg=exact_mean("engagement"), active_sessions=F.sum("sessions")
    )
    return api.join(usage, "window_start", "full")


def _depth(changes: DataFrame, period_s: int) -> DataFrame:
    """Messages waiting at the end of each window, from +1 / -1 changes (``queue, ms, delta``)."""
    series = window_series(changes, "ms", period_s, ["queue"], delta=F.sum("delta"))
    run = Window.partitionBy("queue").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    filled = fill_windows(series, period_s, ["queue"])
    return filled.select("queue", "window_start", F.sum(F.coalesce("delta", F.lit(0))).over(run).alias("depth"))


def _changes(log: DataFrame, *points: tuple[str | Column, int]) -> DataFrame:
    """One row per time a message enters (+1) or leaves (-1); a NULL time is skipped."""
    items = [F.struct((F.col(t) if isinstance(t, str) else t).alias("ms"), F.lit(d).alias("delta")) for t, d in points]
    rows = log.select("queue", F.explode(F.array(*items)).alias("p"))
    return rows.select("queue", "p.ms", "p.delta").where(F.col("ms").isNotNull())


def _gone() -> Column:
    return F.coalesce("deleted_ms", "dead_ms")


def depth_samples(log: DataFrame, sample_s: int = 60) -> DataFrame:
    """Waiting messages per queue, sampled each minute."""
    return _depth(_changes(log, ("sent_ms", 1), (_gone(), -1)), sample_s)


def _depth_alarm(samples: DataFrame, threshold: float | Column, n_periods: int) -> DataFrame:
    series = window_series(samples, "window_start", 300, ["queue"], value=F.avg("depth"))
    return alarm_states(series, 300, ">", threshold, n_periods, by=["queue"])


def alarm_queue_depth(log: DataFrame, limits: dict[str, int] | None = None, n_periods: int = 2) -> DataFrame:
    """Average depth above the queue's own limit; a queue without a limit never alarms."""
    limit = None
    for queue, most in (limits or QUEUE_DEPTH).items():
        hit = F.col("queue") == queue
        limit = F.when(hit, most) if limit is None else limit.when(hit, most)
    no_limit = F.lit(2**62)
    return _depth_alarm(depth_samples(log), limit.otherwise(no_limit), n_periods)


def alarm_dead_letters(log: DataFrame, n_periods: int = 1) -> DataFrame:
    return _depth_alarm(_depth(_changes(log, ("dead_ms", 1)), 60), 0, n_periods)


def queue_health(log: DataFrame, period_s: int = 300) -> DataFrame:
    """Per queue and window: depth, age of the oldest waiting message, messages sent, received, deleted.

    The oldest message waiting at the end of a window is the earliest sent of those gone in a later window, or never,
    if it was sent by then. So each window keeps the earliest send time of what it saw go, and a running
    minimum over the later windows gives the rest: no more rows than windows.
    """
    kinds = {"sent": "sent_ms", "received": "received_ms", "deleted": "deleted_ms"}
    moves = [
        *[F.struct(F.col(t).alias("ms"), F.lit(k).alias("kind"), F.lit(int(k == "sent")).alias("delta")) for k, t in kinds.items()],
        F.struct(_gone().alias("ms"), F.lit("gone").alias("kind"), F.lit(-1).alias("delta")),
    ]
    rows = log.select("queue", "sent_ms", _gone().isNull().alias("stays"), F.explode(F.array(*moves)).alias("m"))
    kind = F.col("kind")
    counts = window_series(
        rows.select("queue", "sent_ms", "stays", "m.*"),
        "ms",
        period_s,
        ["queue"],
        **{k: F.count_if(kind == k) for k in kinds},
        delta=F.sum("delta"),
        gone_oldest=F.min(F.when(kind == "gone", F.col("sent_ms"))),
        stays_oldest=F.min(F.when((kind == "sent") & F.col("stays"), F.col("sent_ms"))),
    )
    queue = Window.partitionBy("queue")
    run = queue.orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    later = queue.orderBy(F.desc("window_start")).rowsBetween(Window.unboundedPreceding, -1)  # grows by one row a step
    end = F.col("window_start") + period_s * 1000
    # least() skips NULL
    oldest = F.least(F.min("gone_oldest").over(later), F.min("stays_oldest").over(queue))
    return fill_windows(counts, period_s, ["queue"]).select(
        "queue",
        "window_start",
        F.sum(F.coalesce("delta", F.lit(0))).over(run).alias("depth"),
        F.when(oldest < end, end - oldest).alias("oldest_age_ms"),
        *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds],
    )
