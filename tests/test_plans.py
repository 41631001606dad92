"""What the physical plans must and must not hold."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakepulse.checks.base import QUERIES
from lakepulse.operators.predicates import current_period
from lakepulse.plans import activity, mart, risk, sessions
from lakepulse.sources import fixture
from lakepulse.sources.fixture import AS_OF

STREAMS_AND_SINKS = ("stream_", "sink_", "src_", "compact_", "tenant_", "flatten_", "partition_", "scan_")
LAZY = [n for n in QUERIES if not n.startswith(STREAMS_AND_SINKS)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_python_or_unbounded_windows(spark, tiny, name):
    text = plan(QUERIES[name](spark, tiny))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF"):
        assert bad not in text


@pytest.fixture(scope="module")
def lake(spark, tiny, tmp_path_factory):
    """``flat`` as the working table: Parquet under year, month, day."""
    path = str(tmp_path_factory.mktemp("lake") / "flat")
    rows = fixture.flat(spark, tiny)
    old = rows.withColumn("year", F.lit("2023"))
    rows.unionByName(old).write.partitionBy("year", "month", "day").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def scans(df):
    return re.findall(r"FileScan parquet.*", plan(df))


def test_the_current_month_prunes_directories(lake):
    df = lake.where(current_period(date(2024, 1, 31)))
    (scan,) = scans(df.select("device_id"))
    assert "PartitionFilters: [isnotnull(year" in scan and "ReadSchema: struct<device_id:string>" in scan
    files = df.select("device_id").inputFiles()
    assert files and {f.split("year=")[1][:4] for f in df.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {"2024"}


@pytest.mark.parametrize(
    ("analysis", "columns"),
    [
        (activity.event_type_overview, {"event_type", "device_id", "session_id"}),
        (sessions.treatment_completion, {"event_type", "device_id", "session_id"}),
        (risk.crisis_intervention, {"event_id", "device_id", "event_type", "event_timestamp", "danger_level",
                                    "probability_level", "response", "focus"}),
    ],
)
def test_scans_read_only_what_is_used(lake, analysis, columns):
    for scan in scans(analysis(lake, AS_OF)):
        read = set(re.findall(r"(\w+):", scan.split("ReadSchema: struct<")[1]))
        assert read <= columns
        assert "PartitionFilters: [" in scan and "(year" in scan


def test_event_type_filters_reach_the_scan(lake):
    for scan in scans(risk.crisis_intervention(lake, AS_OF)):
        assert "EqualTo(event_type,anxiety_session_completed)" in scan
    (scan,) = scans(sessions.treatment_completion(lake, AS_OF))
    assert "In(event_type, [" in scan


def test_single_pass_analyses(lake):
    for f in (activity.daily_active_users, sessions.session_engagement, activity.user_engagement):
        assert len(scans(f(lake, AS_OF))) == 1


@pytest.mark.parametrize(
    ("analysis", "columns"),
    [
        (mart.daily_retention, {"user_id", "event_type", "ts_ms", "year", "month", "day"}),
        (mart.daily_top_features, {"user_id", "event_type", "event_name", "ts_ms", "year", "month", "day"}),
    ],
)
def test_retention_and_features_read_and_shuffle_their_own_columns(spark, tiny, tmp_path, analysis, columns):
    events = fixture.mart_events(fixture.flat(spark, tiny))
    events.write.partitionBy("year", "month", "day").parquet(str(tmp_path / "events"))
    df = analysis(spark.read.schema(events.schema).parquet(str(tmp_path / "events")), AS_OF)
    text = plan(df)
    read = [set(re.findall(r"(\w+):", x)) for x in re.findall(r"ReadSchema: struct<(.*?)>", text)]
    assert len(read) == 1 and read[0] <= columns
    assert "country" not in text and "app_version" not in text


def test_retention_needs_no_join(spark, tiny):
    text = plan(mart.daily_retention(fixture.mart_events(fixture.flat(spark, tiny)), AS_OF))
    assert "Join" not in text and text.count("FileScan") == 1


@pytest.mark.parametrize(
    "analysis", [mart.daily_aggregates, mart.daily_retention, mart.daily_top_features, mart.daily_metrics_mart]
)
def test_the_mart_prunes_directories_and_reads_events_twice_at_most(spark, tiny, tmp_path, monkeypatch, analysis):
    path = str(tmp_path / "events")
    rows = fixture.mart_events(fixture.flat(spark, tiny))
    rows.write.partitionBy("year", "month", "day").parquet(path)
    landed = spark.read.schema(rows.schema).parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    found, plain = [], mart.written
    monkeypatch.setattr(mart, "written", lambda df, name: (found.extend(scans(df)), plain(df, name))[1])
    try:
        found += scans(analysis(landed, date(2024, 1, 31), days=10))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    found = [s for s in found if path in s]
    assert 1 <= len(found) <= 2
    for scan in found:
        assert re.search(r"PartitionFilters: \[.*year.*month.*day", scan)


@pytest.mark.parametrize("analysis", [mart.daily_aggregates, mart.daily_metrics_mart])
def test_the_mart_reads_events_once_and_writes_them_without_a_shuffle(spark, tiny, tmp_path, monkeypatch, analysis):
    path = str(tmp_path / "events")
    rows = fixture.mart_events(fixture.flat(spark, tiny))
    rows.write.partitionBy("year", "month", "day").parquet(path)
    landed = spark.read.schema(rows.schema).parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plans, plain = [], mart.written
    monkeypatch.setattr(mart, "written", lambda df, name: (plans.append(df), plain(df, name))[1])
    try:
        plans.append(analysis(landed, date(2024, 1, 31), days=10))
        assert len([s for df in plans for s in scans(df) if path in s]) == 1
        assert "Exchange" not in plan(plans[0])
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_newest_sessions_are_cut_before_the_shuffle(lake):
    assert plan(risk.crisis_intervention(lake, AS_OF)).count("WindowGroupLimit") == 2


def test_entry_and_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert "date_value" in df.columns and df.count() > 0


def test_unnesting_builds_the_events_of_a_batch_once(spark, tiny):
    text = plan(QUERIES["join_unnest"](spark, tiny))
    assert not [line for line in text.splitlines() if "Filter" in line and "transform(" in line]
    assert "same" in text and text.count("named_struct(session_type") == 1
