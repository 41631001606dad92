"""Every registered query against DuckDB, on the given tables and on a skewed copy of the events."""

import duckdb
import pytest

import __spark_entry__ as entry
from oracle import TABLES, connect, differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
ORDERED = [
    n for n in QUERIES
    if n.startswith(("win_", "response_", "anxiety_", "daily_", "join_", "user_", "crisis", "session_", "agg_", "stream_group",
                     "queue_health", "alarm_queue"))
]


@pytest.fixture(scope="session")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, tiny, con, name):
    df = QUERIES[name](spark, tiny)
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


@pytest.fixture(scope="session")
def skewed(tiny, tmp_path_factory):
    """A third of the events belong to one user, some have no user or type, and many share a time."""
    folder = tmp_path_factory.mktemp("skewed")
    for t in TABLES.split():
        if t != "events":
            (folder / f"{t}.parquet").symlink_to(f"{tiny}/{t}.parquet")
    duckdb.sql(
        f"""COPY (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts,
          CASE WHEN event_id % 3 = 0 THEN 20 WHEN event_id % 50 = 1 THEN NULL ELSE user_id END AS user_id,
          CASE WHEN event_id % 101 = 0 THEN NULL ELSE event_type END AS event_type, value, props
        FROM '{tiny}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)"""
    )
    return str(folder)


@pytest.mark.parametrize("name", ORDERED)
def test_equals_sql_when_runs_are_split(spark, skewed, name):
    spark.conf.set("lakepulse.hotRows", "40")
    try:
        assert differences(QUERIES[name](spark, skewed), connect(skewed), ORACLES[name]) is None
    finally:
        spark.conf.unset("lakepulse.hotRows")
