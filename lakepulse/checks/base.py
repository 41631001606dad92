"""Registry of checked queries, and the SQL that builds the same inputs in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakepulse.session import pin
from lakepulse.sources.fixture import STEPS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _as_text(df: DataFrame) -> DataFrame:
    """Dates as ISO text, so that both engines hand back the same values."""
    dates = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
    return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that must give the same rows."""

    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _as_text(query(pin(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def rounded(x: str, digits: int = 2) -> str:
    scale = f"{10**digits}.0e0"
    return f"(floor(({x}) * {scale} + 0.5e0) / {scale})"


def quotient(part: str, whole: str, digits: int | None = 2, scale: int = 1) -> str:
    q = f"(CAST({part} AS DOUBLE) * {scale}.0e0 / nullif(CAST({whole} AS DOUBLE), 0.0e0))"
    return q if digits is None else rounded(q, digits)


def mean(x: str, where: str = "") -> str:
    """The mean of a double from an exact sum of whole millionths."""
    total = f"sum(CAST(floor({x} * 1000000.0e0 + 0.5e0) AS HUGEINT)){where}"
    return f"({quotient(total, f'count({x}){where}', None)} / 1000000.0e0)"


def pct(part: str, whole: str, digits: int | None = 2) -> str:
    return quotient(part, whole, digits, 100)


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


MS = "(epoch_us(ts) // 1000)"
K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
DONE = "event_type = 'anxiety_session_completed'"
MONTH = "year = '2024' AND month = '01'"

_VALUES = ", ".join(f"('{src}', {n}, '{kind}', {m}, {r})" for src, n, kind, m, r in STEPS)


def _case(key: str, labels: list[str], default: str | None = None) -> str:
    arms = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(labels))
    return f"CASE {key} {arms}{'' if default is None else f' ELSE {default!r}'} END"


SOURCE = f"""src AS (
  SELECT event_id AS src_id, user_id, event_type AS kind, value, {MS} AS src_ms, {K} AS k,
    strftime(ts, '%Y%m%d') AS ymd
  FROM events
)"""

FLAT = f"""steps(kind, step, event_type, m, r) AS (VALUES {_VALUES}),
{SOURCE},
flat AS (
  SELECT 'evt_' || (src_id * 10 + step) AS event_id,
    'device_' || user_id AS device_id,
    'device_' || user_id || '_' || ymd AS session_id,
    event_type,
    src_ms + step * 1000 AS ms,
    CAST(src_ms + step * 1000 AS VARCHAR) AS event_timestamp,
    CASE WHEN event_type = 'screen_view'
      THEN {_case("k % 7", ["Home", "Focus", "Assess", "Respond", "History", ""])} END AS screen_name,
    CASE WHEN event_type = 'danger_level_selected' THEN {_case("k % 4", ["Low", "Medium", "High"], "Very High")}
      WHEN {DONE} THEN CAST(1 + user_id % 5 + k % 6 AS VARCHAR) END AS danger_level,
    CASE WHEN event_type = 'probability_level_selected'
      THEN {_case("k % 4", ["Medium", "Low", "Very High"], "High")}
      WHEN {DONE} THEN CAST(1 + (user_id + k) % 10 AS VARCHAR) END AS probability_level,
    CASE WHEN event_type = 'response_selected' OR {DONE}
      THEN {_case("k % 3", ["Reduce", "Maintain"], "Increase")} END AS response,
    CASE WHEN event_type = 'new_focus_selected' OR {DONE} THEN
      CASE WHEN k % 6 = 4 AND user_id % 10 = 0 THEN 'crisis support' WHEN k % 6 = 4 THEN 'Sleep'
      ELSE {_case("k % 6", ["Health Concerns", "Work Stress", "Relationships", "Financial Worries"])} END
    END AS focus,
    CASE WHEN event_type = 'specific_focus_selected' OR {DONE}
      THEN {_case("k % 2", ["Physical symptoms"], "Job security")} END AS specific_focus,
    value AS duration,
    ymd[1:4] AS year, ymd[5:6] AS month, ymd[7:8] AS day
  FROM src JOIN steps USING (kind) WHERE k % m >= r
),
f AS (
  SELECT *, DATE '1970-01-01' + CAST(ms // 86400000 AS INTEGER) AS d, (ms // 3600000) % 24 AS hr,
    TRY_CAST(danger_level AS DOUBLE) AS danger, TRY_CAST(probability_level AS DOUBLE) AS prob
  FROM flat
),
done AS (SELECT * FROM f WHERE {DONE})"""

MART = f"""{FLAT},
ev AS (
  SELECT device_id AS user_id, session_id, event_type,
    event_type || '_' || (CAST(floor(duration) AS INTEGER) % 12) AS event_name,
    ms AS ts_ms, duration, screen_name,
    CASE WHEN u % 4 = 0 THEN 'premium' ELSE 'free' END AS subscription_status,
    {_case("u % 3", ["iPhone", "iPad"], "Android")} AS device_type,
    CASE WHEN day < '15' THEN '1.0.0' ELSE '1.1.0' END AS app_version,
    {_case("u % 5", ["US", "CA", "GB", "DE"], "FR")} AS country,
    year, month, day
  FROM (SELECT *, CAST(device_id[8:] AS INTEGER) AS u FROM f)
)"""

# The same events once more, 30 days earlier.
HISTORY = f"""{MART.replace("ev AS (", "base AS (")},
ev AS (
  SELECT * FROM base UNION ALL
  SELECT * EXCLUDE (t) REPLACE (strftime(t, '%Y') AS year, strftime(t, '%m') AS month, strftime(t, '%d') AS day)
  FROM (SELECT * REPLACE (ts_ms - 2592000000 AS ts_ms), make_timestamp((ts_ms - 2592000000) * 1000) AS t FROM base)
)"""

HTTP = f"""http AS (
  SELECT {MS} AS ms, value / 100.0e0 AS latency_s,
    CASE WHEN event_type = 'error' AND {K} % 2 = 0 THEN 1 ELSE 0 END AS is_4xx,
    CASE WHEN event_type = 'error' AND {K} % 2 = 1 THEN 1 ELSE 0 END AS is_5xx
  FROM events
)"""

MESSAGES = f"""messages AS (
  SELECT 'm' || event_id || '_' || c AS message_id,
    CASE event_type WHEN 'purchase' THEN 'analytics' WHEN 'signup' THEN 'emails' ELSE 'feedback' END AS queue,
    'g' || user_id AS group_id,
    CASE WHEN event_id % 50 = 7 THEN 'm' || event_id || '_' || c END AS dedup_id,
    CASE WHEN event_id % 50 = 7 THEN '{{bad'
      ELSE '{{"event_id":' || event_id || ',"user_id":' || user_id || '}}' END AS body,
    {MS} + c * 2000 AS sent_ms, event_id, user_id
  FROM (
    SELECT *, unnest(CASE WHEN event_id % 10 = 3 THEN [0, 1] ELSE [0] END) AS c FROM events
  )
),
log AS (
  SELECT queue, message_id, sent_ms, sent_ms + sent_ms % 240000 AS received_ms,
    CASE WHEN body <> '{{bad' THEN sent_ms + sent_ms % 240000 + sent_ms % 600000 END AS deleted_ms,
    CASE WHEN body = '{{bad' THEN sent_ms + sent_ms % 240000 + 900000 END AS dead_ms
  FROM messages
)"""


def with_flat(body: str) -> str:
    """``body`` starts with SELECT, or with a comma and further CTEs."""
    return f"WITH {FLAT}\n{body.strip()}"


def with_mart(body: str) -> str:
    return f"WITH {MART}\n{body.strip()}"


def with_history(body: str) -> str:
    return f"WITH {HISTORY}\n{body.strip()}"


def with_http(body: str) -> str:
    return f"WITH {HTTP}\n{body.strip()}"


def with_messages(body: str) -> str:
    return f"WITH {MESSAGES}\n{body.strip()}"
