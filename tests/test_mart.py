"""Mart: retention against brute force, ties, zero divisors, refresh."""

import random
from datetime import date

import pytest

from conftest import ms
from lakepulse.functions.exprs import DAY_MS
from lakepulse.plans import mart

AS_OF = date(2024, 1, 31)
T0 = ms("2024-01-02T10:30:00")


def brute(rows, h):
    """Users per first-open day that have an event in [t + h days, t + (h + 1) days)."""
    out = {}
    for a in rows:
        if a["event_type"] == "first_open" and a["user_id"] is not None:
            lo = a["ts_ms"] + h * DAY_MS
            if any(r["user_id"] == a["user_id"] and lo <= r["ts_ms"] < lo + DAY_MS for r in rows):
                out.setdefault(a["ts_ms"] // DAY_MS, set()).add(a["user_id"])
    return {k: len(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_retention_equals_brute_force(mart_of, seed):
    rng = random.Random(seed)
    rows = [
        {
            "user_id": rng.choice(["hot"] * 4 + ["a", "b", "c", "d", None]),
            "event_type": rng.choice(["first_open", "screen_view", "screen_view"]),
            "ts_ms": T0 + rng.choice([rng.randrange(40 * DAY_MS), rng.randrange(40) * DAY_MS, rng.randrange(40) * DAY_MS - 1]),
        }
        for _ in range(120)
    ]
    got = mart.daily_retention(mart_of(rows), AS_OF, days=90).collect()
    base = {}
    for r in rows:
        if r["event_type"] == "first_open":
            base.setdefault(r["ts_ms"] // DAY_MS, set()).update({r["user_id"]} - {None})
    day = lambda r: ms(f"{r.year}-{r.month}-{r.day}T00:00:00") // DAY_MS
    assert {day(r): r.new_users_base for r in got} == {k: len(v) for k, v in base.items()}
    for h in (1, 7, 30):
        assert {day(r): r[f"day_{h}_retained"] for r in got if r[f"day_{h}_retained"]} == brute(rows, h)


@pytest.mark.parametrize(
    ("offset", "back"), [(DAY_MS - 1, 0), (DAY_MS, 1), (2 * DAY_MS - 1, 1), (2 * DAY_MS, 0)]
)
def test_retention_interval_is_half_open(mart_of, offset, back):
    rows = [{"user_id": "a", "event_type": "first_open", "ts_ms": T0}, {"user_id": "a", "ts_ms": T0 + offset}]
    assert mart.daily_retention(mart_of(rows), AS_OF).first().day_1_retained == back
    assert mart.first_open_returns(mart_of(rows), AS_OF).first().day_1 == back


def test_min_year_limits_first_opens_only(mart_of):
    rows = [
        {"user_id": "a", "event_type": "first_open", "ts_ms": ms("2023-12-31T12:00:00")},
        {"user_id": "a", "ts_ms": ms("2024-01-01T13:00:00")},
        {"user_id": "b", "event_type": "first_open", "ts_ms": T0},
    ]
    events = mart_of(rows)
    assert mart.daily_retention(events, AS_OF).count() == 2
    assert [r.year for r in mart.daily_retention(events, AS_OF, min_year="2024").collect()] == ["2024"]


def test_events_before_the_period_do_not_count(mart_of):
    rows = [{"user_id": "a", "ts_ms": ms("2023-11-01T23:59:59")}, {"user_id": "a", "ts_ms": ms("2023-11-02T00:00:00")}]
    got = mart.daily_aggregates(mart_of(rows), AS_OF).collect()
    assert [(r.month, r.day, r.total_events) for r in got] == [("11", "02", 1)]


def test_daily_aggregates(mart_of):
    rows = [
        {"user_id": "a", "session_id": "s", "ts_ms": T0, "duration": 2.0, "app_version": "2", "country": "US",
         "subscription_status": "premium", "device_type": "iPad", "screen_name": "Home", "event_name": "x"},
        {"user_id": "a", "session_id": "s", "ts_ms": T0 + 1, "duration": 4.0, "app_version": "1", "country": "CA",
         "subscription_status": "free", "event_type": "crash"},
        {"user_id": "b", "session_id": "s", "ts_ms": T0 + 2, "event_type": "performance", "duration": 9.0, "country": "CA"},
        {"user_id": None, "session_id": None, "ts_ms": T0 + 3, "subscription_status": "premium", "event_type": "error"},
    ]
    r = mart.daily_aggregates(mart_of(rows), AS_OF).first()
    assert (r.daily_active_users, r.total_sessions, r.total_events) == (2, 1, 4)
    assert (r.premium_users, r.free_users, r.ipad_users) == (1, 1, 1)
    assert (r.most_common_app_version, r.most_common_country) == ("1", "CA")  # the tie goes to the lower version
    assert (r.app_versions_active, r.countries_active, r.unique_screens_accessed, r.unique_events_triggered) == (2, 2, 1, 1)
    assert (r.avg_session_duration, r.avg_performance_load_time, r.p95_performance_load_time) == (5.0, 9.0, 9.0)
    assert (r.error_rate_percent, r.crash_rate_percent) == (25.0, 100.0)


def test_a_day_without_sessions_has_no_rates(mart_of):
    r = mart.daily_metrics_mart(mart_of([{"user_id": None, "ts_ms": T0}]), AS_OF).first()
    assert (r.daily_active_users, r.total_events, r.avg_events_per_user, r.crash_rate_percent) == (0, 1, None, None)
    assert r.new_users_base is None and r.top_features is None and r.date_value == date(2024, 1, 2)


def test_top_features_keep_order_and_break_ties_by_name(mart_of):
    names = ["b"] * 3 + ["a"] * 3 + ["z"] * 5 + [f"f{i:02d}" for i in range(12)]
    rows = [{"user_id": f"u{i % 2}", "event_type": "feature_usage", "event_name": n, "ts_ms": T0 + i} for i, n in enumerate(names)]
    top = mart.daily_top_features(mart_of(rows), AS_OF).first().top_features
    assert [(f.event_name, f.usage_count) for f in top[:4]] == [("z", 5), ("a", 3), ("b", 3), ("f00", 1)]
    assert len(top) == 10 and top[0].unique_users == 2


def test_refresh_replaces_only_the_days_it_holds(spark, tmp_path, mart_of):
    path = str(tmp_path / "mart")
    two = mart.daily_metrics_mart(mart_of([{"user_id": "a", "ts_ms": T0}, {"user_id": "a", "ts_ms": T0 + DAY_MS}]), AS_OF)
    mart.write_mart(two, path)
    again = mart.daily_metrics_mart(mart_of([{"user_id": u, "ts_ms": T0} for u in "ab"]), AS_OF)
    mart.write_mart(again, path)
    got = spark.read.schema(two.schema).parquet(path).orderBy("day").collect()
    assert [(r.day, r.daily_active_users) for r in got] == [("02", 2), ("03", 1)]
    assert got[0].year == "2024"


@pytest.mark.parametrize("partitions", [1, 3, 8, 16, 200])
def test_averages_do_not_depend_on_the_shuffle(spark, mart_of, partitions):
    """Sums of doubles would: these round differently at a tie, depending on their order."""
    rng = random.Random(3)
    events = [
        {"user_id": f"u{i % 17}", "session_id": f"s{i % 40}", "event_type": "performance", "ts_ms": T0 + i * 1000, "duration": rng.choice([0.1, 0.2, 0.7, 3.3, 1e5 + 0.01])}
        for i in range(800)
    ]
    total = sum(round(e["duration"] * 10**6) for e in events)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        daily = mart.daily_aggregates(mart_of(events).repartition(partitions), AS_OF).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.avg_session_duration for r in daily] == [float(total) / 800 / 1e6] == [r.avg_performance_load_time for r in daily]
