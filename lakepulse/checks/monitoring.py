"""Windowed series and alarms."""

from __future__ import annotations

from lakepulse.checks.base import HTTP, K, MESSAGES, MS, big, check, mean, rounded
from lakepulse.functions.exprs import round_half_up
from lakepulse.plans import monitoring as m
from lakepulse.sources.fixture import app_metrics, http_metrics, message_log, query_log


def spine(period_s: int, by: str = "") -> str:
    """Windows from the first to the last of ``series``."""
    keys = f"{by}, " if by else ""
    step = period_s * 1000
    group = f"GROUP BY {by}" if by else ""
    return (
        f"spine AS (SELECT {keys}unnest(range(min(window_start), max(window_start) + 1, {step})) AS window_start "
        f"FROM series {group})"
    )


def alarm(ctes: str, period_s: int, breach: str, n: int, by: str = "", missing: bool = True) -> str:
    """``ctes`` end in ``series(window_start, value [, by])``."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    unknown = "WHEN count(breach) OVER w = 0 THEN 'INSUFFICIENT_DATA'" if missing else ""
    test = f"CAST({breach} AS INTEGER)" if missing else f"coalesce(CAST({breach} AS INTEGER), 0)"
    return f"""{ctes}, {spine(period_s, by)},
filled AS (SELECT *, {test} AS breach FROM spine LEFT JOIN series USING ({keys}window_start))
SELECT {keys}window_start, {rounded('value', 6)} AS value, breach,
    CASE WHEN sum(breach) OVER w = {n} THEN 'ALARM' {unknown} ELSE 'OK' END AS state
  FROM filled WINDOW w AS ({part} ORDER BY window_start ROWS {n - 1} PRECEDING)"""


def window(ms: str, period_s: int) -> str:
    return f"({ms} // {period_s * 1000}) * {period_s * 1000} AS window_start"


def _six(df, *columns):
    return df.withColumns({c: round_half_up(c, 6) for c in columns or ("value",)})


ERROR_RATE = f"""WITH {HTTP}, series AS (
  SELECT {window('ms', 300)}, CAST(sum(is_4xx + is_5xx) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0e0 AS value
  FROM http GROUP BY 1)"""


@check("alarm_error_rate", alarm(ERROR_RATE, 300, "value > 5", 2))
def _(spark, sf):
    return _six(m.alarm_error_rate(http_metrics(spark, sf)))


@check(
    "alarm_response_time_p99",
    alarm(
        f"WITH {HTTP}, series AS (SELECT {window('ms', 300)}, quantile_disc(latency_s, 0.99) AS value FROM http GROUP BY 1)",
        300,
        "value > 3",
        2,
    ),
)
def _(spark, sf):
    return _six(m.alarm_response_time_p99(http_metrics(spark, sf)))


@check(
    "alarm_low_engagement",
    alarm(
        f"""WITH series AS (SELECT {window(MS, 900)}, {mean('value')} AS value FROM events
  WHERE event_type = 'view' GROUP BY 1)""",
        900,
        "value < 50",
        4,
        missing=False,
    ),
)
def _(spark, sf):
    return _six(m.alarm_low_engagement(app_metrics(spark, sf)))


@check(
    "alarm_scan_cost",
    alarm(
        f"""WITH series AS (SELECT {window(MS, 300)}, CAST(sum(CAST({K} AS BIGINT) * 1500000000) AS BIGINT) AS value
  FROM events GROUP BY 1)""",
        300,
        "value > 107374182400",
        2,
    ),
)
def _(spark, sf):
    return _six(m.alarm_scan_cost(query_log(spark, sf)))


def _depth(moves: str) -> str:
    """Depth at the end of each minute, then its mean per 300 s."""
    return f"""WITH {MESSAGES}, moves AS ({moves}),
minutes AS (SELECT queue, ms // 60000 AS minute, sum(delta) AS delta FROM moves WHERE ms IS NOT NULL GROUP BY ALL),
every_minute AS (SELECT queue, unnest(range(min(minute), max(minute) + 1)) AS minute FROM minutes GROUP BY queue),
samples AS (
  SELECT queue, minute * 60000 AS ms,
    sum(coalesce(delta, 0)) OVER (PARTITION BY queue ORDER BY minute) AS depth
  FROM every_minute LEFT JOIN minutes USING (queue, minute)
), series AS (SELECT queue, {window('ms', 300)}, avg(depth) AS value FROM samples GROUP BY ALL)"""


_LIMIT = "CASE queue WHEN 'feedback' THEN 100 WHEN 'emails' THEN 500 WHEN 'analytics' THEN 1000 WHEN 'testflight' THEN 50 END"
SENT_GONE = (
    "SELECT queue, sent_ms AS ms, 1 AS delta FROM log UNION ALL SELECT queue, coalesce(deleted_ms, dead_ms), -1 FROM log"
)


@check("alarm_queue_depth", alarm(_depth(SENT_GONE), 300, f"value > {_LIMIT}", 2, by="queue"))
def _(spark, sf):
    return _six(m.alarm_queue_depth(message_log(spark, sf)))


@check(
    "alarm_dead_letters",
    alarm(_depth("SELECT queue, dead_ms AS ms, 1 AS delta FROM log"), 300, "value > 0", 1, by="queue"),
)
def _(spark, sf):
    return _six(m.alarm_dead_letters(message_log(spark, sf)))


@check(
    "metric_dashboard_series",
    f"""WITH {HTTP}, api AS (
  SELECT {window('ms', 300)}, count(*) AS requests, {rounded(mean('latency_s'), 6)} AS latency_avg,
    quantile_disc(latency_s, 0.99) AS latency_p99, {big('sum(is_4xx)')} AS errors_4xx, {big('sum(is_5xx)')} AS errors_5xx
  FROM http GROUP BY 1
), app AS (
  SELECT {window(MS, 300)}, {rounded(mean('value', " FILTER (WHERE event_type = 'view')"), 6)} AS engagement_avg,
    count(*) FILTER (WHERE event_type = 'click') AS active_sessions
  FROM events GROUP BY 1
) SELECT * FROM api FULL JOIN app USING (window_start)""",
)
def _(spark, sf):
    series = m.dashboard_series(http_metrics(spark, sf), app_metrics(spark, sf))
    return _six(series, "latency_avg", "engagement_avg")


@check(
    "queue_health",
    f"""WITH {MESSAGES}, gone AS (SELECT *, coalesce(deleted_ms, dead_ms) AS gone_ms FROM log),
moves AS (
  SELECT queue, sent_ms AS ms, 's' AS kind FROM gone UNION ALL SELECT queue, received_ms, 'r' FROM gone
  UNION ALL SELECT queue, deleted_ms, 'd' FROM gone UNION ALL SELECT queue, gone_ms, 'g' FROM gone
), series AS (
  SELECT queue, {window('ms', 300)}, count(*) FILTER (WHERE kind = 's') AS sent,
    count(*) FILTER (WHERE kind = 'r') AS received, count(*) FILTER (WHERE kind = 'd') AS deleted
  FROM moves WHERE ms IS NOT NULL GROUP BY ALL
), {spine(300, 'queue')},
waiting AS (
  SELECT s.queue, s.window_start, count(*) AS depth, s.window_start + 300000 - min(sent_ms) AS oldest_age_ms
  FROM spine s JOIN gone g ON g.queue = s.queue AND g.sent_ms < s.window_start + 300000
    AND coalesce(g.gone_ms, 9000000000000) >= s.window_start + 300000
  GROUP BY s.queue, s.window_start
) SELECT queue, window_start, coalesce(depth, 0) AS depth, oldest_age_ms, coalesce(sent, 0) AS sent,
    coalesce(received, 0) AS received, coalesce(deleted, 0) AS deleted
  FROM spine LEFT JOIN series USING (queue, window_start) LEFT JOIN waiting USING (queue, window_start)""",
)
def _(spark, sf):
    return m.queue_health(message_log(spark, sf))
