"""Readers, flattening, partitions and sinks on files."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lakepulse.operators.flatten import flatten_events, to_flat
from lakepulse.operators.predicates import between_days
from lakepulse.session import scratch
from lakepulse.sources import fixture, lake, sinks


def put(root, day, name, *lines, hour="05"):
    folder = root / f"year={day:%Y}" / f"month={day:%m}" / f"day={day:%d}"
    folder = folder / f"hour={hour}" if hour else folder
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines))


def batch(name, events):
    return {"batch_id": name, "batch_metadata": {"device_id": "d", "session_id": "s"}, "events": events}


EVENT = {
    "event_id": "e1", "timestamp": 1, "event_type": "screen_view",
    "focus_session": {"duration_seconds": 3.5, "interruptions": 2},
    "breathing_exercise": {"session_duration": 4.5, "guide_used": True},
    "danger_probability": {"danger_level": "7", "context": "work"},
    "user_interaction": {"position": {"x": 1.5, "y": 2.5}},
}


def test_flatten_drops_batches_without_events(spark, tmp_path):
    lines = [batch("b1", [EVENT, {"event_id": "e2"}]), batch("b2", []), batch("b3", None), {"batch_id": "b4"}, "{broken"]
    put(tmp_path, date(2024, 7, 3), "f.json", *lines)
    rows = lake.read_batches(spark, str(tmp_path))
    assert sorted((r.batch_id or "", r._corrupt_record) for r in rows.select("batch_id", "_corrupt_record").collect()) == [
        ("", "{broken"), ("b1", None), ("b2", None), ("b3", None), ("b4", None)
    ]
    got = flatten_events(rows).orderBy("event_id").collect()
    assert [r.event_id for r in got] == ["e1", "e2"]
    first = got[0]
    assert (first.focus_duration, first.breathing_duration, first.danger_context) == (3.5, 4.5, "work")
    assert (first.click_x, first.click_y, first.guide_used, first.danger_level) == (1.5, 2.5, True, "7")
    assert (first.year, first.month, first.day, first.hour) == ("2024", "07", "03", "05")
    assert got[1].danger_level is None and len(got[1]) == 52 + 3


def test_min_year_prunes_directories(spark, tmp_path):
    put(tmp_path, date(2023, 7, 3), "f.json", batch("b1", [EVENT]))
    put(tmp_path, date(2024, 7, 3), "f.json", batch("b2", [EVENT]))
    flat = flatten_events(lake.read_batches(spark, str(tmp_path)), min_year="2024")
    assert [r.batch_id for r in flat.collect()] == ["b2"]
    assert "PartitionFilters: [isnotnull(year" in flat._jdf.queryExecution().toString()


def test_round_trip_of_the_fixture(spark, tiny, tmp_path):
    path = str(tmp_path / "lake")
    sinks.write_json(fixture.batches(spark, tiny), path)
    back, want = to_flat(flatten_events(lake.read_batches(spark, path))), fixture.flat(spark, tiny)
    assert back.exceptAll(want.select(back.columns)).count() == 0
    assert want.select(back.columns).exceptAll(back).count() == 0
    assert list((tmp_path / "lake").rglob("*.json.gz"))


def test_hand_written_rows_of_the_other_tables(spark, tmp_path):
    put(
        tmp_path / "t", date(2025, 1, 9), "f.json",
        {"transaction_id": "t1", "amount": 9.99, "subscription_info": {"plan_type": "year", "renewal_date": 7}},
        {"transaction_id": "t2", "risk_assessment": {"fraud_indicators": ["ip", "card"]}, "refund_info": None}, hour=None,
    )
    t1, t2 = lake.read_transactions(spark, str(tmp_path / "t")).orderBy("transaction_id").collect()
    assert (t1.amount, t1.subscription_info.renewal_date, t1.month) == (9.99, 7, "01")
    assert t2.refund_info is None and t2.risk_assessment.fraud_indicators == ["ip", "card"]

    put(
        tmp_path / "f", date(2025, 1, 9), "f.json",
        {"feedback_id": "f1", "tags": ["a"], "attachments": [{"type": "log", "size": 5}, {"filename": "x"}]}, hour=None,
    )
    f1 = lake.read_feedback(spark, str(tmp_path / "f")).first()
    assert [a.size for a in f1.attachments] == [5, None] and f1.app_state is None

    put(
        tmp_path / "b", date(2025, 1, 9), "f.json",
        {"behavior_id": "b1", "engagement_patterns": {"feature_usage_frequency": {"x": 3}},
         "user_preferences": {"notification_settings": {"daily": False}, "privacy_settings": {}}},
    )
    b1 = lake.read_user_behavior(spark, str(tmp_path / "b")).first()
    assert b1.engagement_patterns.feature_usage_frequency == {"x": 3}
    assert b1.user_preferences.notification_settings == {"daily": False} and b1.hour == "05"


def test_raw_events_by_partition(spark, tmp_path):
    row = {"event_id": "e", "timestamp": "2024-01-15 14:00:00", "user_id": "u", "properties": {"page": "/home"}}
    for hour, kinds in {"09": "a", "10": "ab", "14": "aab", "15": "b"}.items():
        put(tmp_path, date(2024, 1, 15), "f.json", *[row | {"event_type": k} for k in kinds], hour=hour)
    raw = lake.read_raw_events(spark, str(tmp_path))
    assert raw.first().properties == {"page": "/home"}
    got = lake.count_by_type(raw, (F.col("year") == 2024) & F.col("hour").between(10, 14))
    assert {r.event_type: r.event_count for r in got.collect()} == {"a": 3, "b": 2}


def test_metrics_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        'timestamp,metric_name,value,tags\n2024-01-01 00:00:00,cpu,75.5,host=web-01\n2024-01-01 00:00:00,mem,,"host=w,zone=b"\n'
    )
    cpu, mem = lake.read_metrics_csv(spark, str(tmp_path)).orderBy("metric_name").collect()
    assert (cpu.value, cpu.tags) == (75.5, {"host": "web-01"})
    assert (mem.value, mem.tags) == (None, {"host": "w", "zone": "b"})


def test_partition_paths_and_discovery(spark, tmp_path):
    for d in (date(2024, 1, 31), date(2024, 2, 1), date(2024, 2, 2)):
        put(tmp_path, d, "f.json", batch(f"b{d:%d}", [EVENT]))
    paths = lake.partition_paths(str(tmp_path), date(2024, 1, 31), date(2024, 2, 1))
    got = lake.read_batches(spark, paths, base_path=str(tmp_path)).select("batch_id", "month").collect()
    assert sorted(map(tuple, got)) == [("b01", "02"), ("b31", "01")]
    assert len(lake.partition_paths("x", date(2024, 1, 1), date(2024, 1, 1), hours=True)) == 24

    where = between_days(date(2024, 2, 1), date(2024, 2, 2))
    found = lake.discover_partitions(spark, str(tmp_path), where).orderBy("day").collect()
    assert [(r.month, r.day, r.files) for r in found] == [(2, 1, 1), (2, 2, 1)]
    size = sum(p.stat().st_size for p in tmp_path.rglob("month=02/**/*.json"))
    cost = lake.scan_cost(lake.list_objects(spark, str(tmp_path)), where).first()
    assert (cost.files, cost.bytes, cost.over_limit) == (2, size, 0)
    assert lake.scan_cost(lake.list_objects(spark, str(tmp_path)), where, limit_bytes=size - 1).first().over_limit == 1


def test_partitions_come_from_event_time(spark):
    rows = spark.createDataFrame([(1704067199999,), (1704067200000,)], "ms bigint")
    padded = sinks.with_partitions(rows, "ms").select(*sinks.HOURLY).collect()
    assert [tuple(r) for r in padded] == [("2023", "12", "31", "23"), ("2024", "01", "01", "00")]
    plain = sinks.with_partitions(rows, "ms", padded=False).select(*sinks.HOURLY).collect()
    assert [tuple(r) for r in plain] == [(2023, 12, 31, 23), (2024, 1, 1, 0)]


@pytest.mark.parametrize(
    ("path", "age", "tier", "action"),
    [
        ("data/x", 29, "STANDARD", "KEEP"), ("data/x", 30, "STANDARD_IA", "TRANSITION"),
        ("data/x", 90, "GLACIER", "TRANSITION"), ("data/x", 365, "DEEP_ARCHIVE", "TRANSITION"),
        ("temp/x", 6, "STANDARD", "KEEP"), ("temp/x", 7, "STANDARD", "EXPIRE"),
        ("query-results/x", 29, "STANDARD", "KEEP"), ("query-results/x", 30, "STANDARD_IA", "EXPIRE"),
        ("data/temp/x", 8, "STANDARD", "KEEP"),
    ],
)
def test_retention_plan(spark, path, age, tier, action):
    modified = datetime.fromordinal(date(2024, 1, 31).toordinal() - age)
    listing = spark.createDataFrame([(path, 1, modified)], "path string, size bigint, modified timestamp_ntz")
    row = sinks.retention_plan(listing, date(2024, 1, 31)).first()
    assert (row.age_days, row.storage_class, row.action) == (age, tier, action)


def test_a_hot_partition_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(60_000).selectExpr(
        "concat('e', id) event_id", "sha2(cast(id as string), 256) body", "'2024' year", "'01' month",
        "if(id % 3 = 0, '01', lpad(cast(id % 20 + 2 as string), 2, '0')) day",
    ).repartition(8)
    path = str(tmp_path / "hot")
    sinks.compact(rows, path, ["year", "month", "day"], target_size="256KB")
    files = list((tmp_path / "hot").rglob("day=01/*.parquet"))
    assert len(files) > 1
    assert spark.read.parquet(path).count() == 60_000
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") != "256KB"


def test_scratch_is_the_folder_the_cluster_names(spark, tmp_path, monkeypatch):
    settings = {"spark.checkpoint.dir": "hdfs://shared/dir/"}

    class Conf:
        def get(self, name, default=None):
            return settings.get(name, default)

    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    assert scratch(Session(), "x").startswith("hdfs://shared/dir/lakepulse/app/x-")
    settings.clear()
    with pytest.raises(RuntimeError):
        scratch(Session(), "x")


def test_the_mapping_reads_every_source_event(spark, tiny):
    from pyspark.sql import functions as F

    from lakepulse.sources import fixture

    source = fixture.events(spark, tiny)
    assert fixture.batches(spark, tiny).count() == source.count()
    kinds = [k for k in ("view", "click", "error")]
    some = fixture.flat(spark, tiny).select((F.substring("event_id", 5, 20).cast("long") / 10).cast("long").alias("i")).distinct()
    assert some.count() >= source.where(F.col("event_type").isin(kinds)).count()


def test_writers_keep_files_open_side_by_side(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    seen, write = [], DataFrameWriter.parquet
    name = "spark.sql.maxConcurrentOutputFileWriters"
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(spark.conf.get(name)), write(self, *a, **k)))
    rows = spark.range(200).selectExpr("id", "CAST(id % 20 AS STRING) AS day")
    sinks.compact(rows, str(tmp_path / "compacted"), ["day"])
    sinks.append(rows, str(tmp_path / "appended"), ["day"])
    assert seen == ["8", "8"] and spark.conf.get(name) == "0"
    for part in ("compacted", "appended"):
        assert spark.read.schema("id bigint, day string").parquet(str(tmp_path / part)).selectExpr("count(*)", "sum(id)").first() == (200, 19900)
