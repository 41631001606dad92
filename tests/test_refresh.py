"""Listings by tasks and what changed between them; the mart after late events against a full rebuild."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import ms
from lakepulse.functions.exprs import DAY_MS
from lakepulse.plans import mart, refresh
from lakepulse.sources import listing

AS_OF = date(2024, 2, 20)
T0 = ms("2024-01-02T00:00:00")


def events(seed, n=400):
    rng = random.Random(seed)
    return [
        {
            "user_id": rng.choice(["a", "b", "c", "d", None]),
            "session_id": f"s{rng.randrange(60)}",
            "event_type": rng.choice(["first_open", "screen_view", "feature_usage", "performance"]),
            "event_name": rng.choice(["x", "y", "z"]),
            "duration": rng.choice([0.1, 2.5, None]),
            "ts_ms": T0 + rng.randrange(48 * DAY_MS),
        }
        for _ in range(n)
    ]


def land(df, path):
    df.repartition("year", "month", "day").write.mode("append").partitionBy("year", "month", "day").parquet(path)


def files(spark, path):
    return {r["path"]: r["size"] for r in listing.list_files(spark, path).collect()}


def test_listing_finds_all_files_of_any_depth(spark, tmp_path):
    for name, size in (("a.bin", 3), ("x=1/b.bin", 0), ("x=1/y=2/c.bin", 7), ("x=2/_tmp/d.bin", 1), ("x=2/.e", 1), ("_SUCCESS", 0)):
        at = tmp_path / "in" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"z" * size)
    (tmp_path / "in" / "empty").mkdir()
    assert files(spark, str(tmp_path / "in")) == {"a.bin": 3, "x=1/b.bin": 0, "x=1/y=2/c.bin": 7}
    assert files(spark, f"file:{tmp_path}/in/x=1/") == {"b.bin": 0, "y=2/c.bin": 7}
    assert files(spark, str(tmp_path / "none")) == {}


def test_changes_between_listings(spark):
    rows = lambda *x: spark.createDataFrame([(f"year=2024/month=01/day={d}/{n}", size, at) for d, n, size, at in x], "path string, size long, modified long")
    before = rows(("01", "a", 1, 1), ("02", "a", 1, 1), ("03", "a", 1, 1), ("04", "a", 1, 1), ("05", "a", 1, 1), ("05", "b", 1, 1))
    after = rows(("01", "a", 1, 1), ("02", "a", 1, 2), ("03", "a", 2, 1), ("05", "b", 1, 1), ("06", "a", 9, 1))
    got = listing.partition_changes(before, after).orderBy("day").collect()
    assert [(r["day"], r["change"], r["files_before"], r["bytes_after"]) for r in got] == [
        ("02", "changed", 1, 1), ("03", "changed", 1, 2), ("04", "dropped", 1, 0), ("05", "changed", 2, 1), ("06", "added", 0, 9),
    ]
    assert refresh.changed_days(listing.partition_changes(before, after)) == {date(2024, 1, d) for d in range(2, 7)}
    assert listing.partition_changes(after, after).count() == 0


def test_a_changed_directory_makes_the_days_stale_that_read_it():
    for slack in (0, 1, 2):
        for changed in (date(2024, 1, 5), date(2024, 3, 1)):
            stale = refresh.stale_days([changed], slack)
            assert changed in stale
            for other in (date.fromordinal(changed.toordinal() + k) for k in range(-40, 41)):
                assert (changed in refresh.needed_days([other], slack)) <= (other in stale)
        two = [date(2024, 1, 5), date(2024, 1, 20)]
        for f in (refresh.stale_days, refresh.needed_days):
            assert f(two, slack) == f(two[:1], slack) | f(two[1:], slack)


@pytest.mark.parametrize("seed", range(2))
def test_refresh_equals_a_full_rebuild(spark, tmp_path, mart_of, seed):
    rows = mart_of(events(seed))
    late = F.col("day").isin("17", "18") & (F.col("month") == "01") & (F.col("ts_ms") % 2 == 0) | (F.col("ts_ms") % 97 == 0)
    source, path = str(tmp_path / "events"), str(tmp_path / "mart")
    land(rows.where(~late), source)
    before = listing.list_files(spark, source)
    read = lambda: spark.read.schema(rows.schema).parquet(source)
    first = mart.daily_metrics_mart(read(), AS_OF)
    columns = first.columns
    mart.write_mart(first, path)
    untouched = files(spark, path)
    land(rows.where(late), source)
    changes = listing.partition_changes(before, listing.list_files(spark, source))
    done = refresh.refresh_mart(read(), path, refresh.changed_days(changes), AS_OF)
    got = spark.read.schema(first.schema).parquet(path).select(columns).orderBy("year", "month", "day").collect()
    assert got == mart.daily_metrics_mart(rows, AS_OF).collect()
    stay = {p for p in untouched if not any(f"year={d:%Y}/month={d:%m}/day={d:%d}/" in p for d in done)}
    assert stay and stay <= set(files(spark, path))


def test_a_day_without_events_leaves_the_mart(spark, tmp_path, mart_of):
    rows = mart_of(events(5))
    source, path = str(tmp_path / "events"), str(tmp_path / "mart")
    land(rows.where("NOT (month = '01' AND day = '10')"), source)
    full = mart.daily_metrics_mart(rows, AS_OF)
    columns = full.columns
    mart.write_mart(full, path)
    events_now = spark.read.schema(rows.schema).parquet(source)
    done = refresh.refresh_mart(events_now, path, [date(2024, 1, 10)], AS_OF)
    assert date(2024, 1, 10) not in done and done
    got = spark.read.schema(full.schema).parquet(path).select(columns).orderBy("year", "month", "day").collect()
    assert got == mart.daily_metrics_mart(events_now, AS_OF).collect()
    assert refresh.refresh_mart(events_now, path, [], AS_OF) == []


def test_refresh_reads_needed_directories_only(spark, tmp_path, mart_of):
    rows = mart_of(events(6))
    source = str(tmp_path / "events")
    land(rows, source)
    needed = refresh.needed_days(refresh.stale_days([date(2024, 2, 15)]))
    read = spark.read.schema(rows.schema).parquet(source).where(refresh.in_days(needed))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "make_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    days = {date(*map(int, (r.year, r.month, r.day))) for r in read.select("year", "month", "day").distinct().collect()}
    assert days and days <= needed and len(days) < rows.select("year", "month", "day").distinct().count()
