"""Users and percentiles over ranges of days against brute force, and the sketches' rank error."""

import random
from bisect import bisect_left, bisect_right
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lakepulse.functions.exprs import to_ms
from lakepulse.plans import mart, ranges

FIRST, LAST = date(2023, 12, 20), date(2024, 1, 31)
WIDE_APART = "user_id string, user_no bigint"


def day(n):
    return FIRST + timedelta(days=n)


def events(seed, n=600, users=40, span=43):
    rng = random.Random(seed)
    quiet = set(range(9, 16)) if seed % 2 else set()  # a week that nobody is active in
    rows = []
    while len(rows) < n:
        d = rng.randrange(span)
        if d not in quiet:
            rows.append(
                {
                    "user_id": rng.choice(["hot", None, *[f"u{i}" for i in range(users)]]),
                    "event_type": rng.choice(["first_open", "screen_view", "screen_view", "performance"]),
                    "subscription_status": rng.choice(["premium", "free", None]),
                    "duration": rng.choice([None, rng.random() * 50]),
                    "ts_ms": to_ms(day(d)) + rng.randrange(86_400_000),
                }
            )
    return rows


def marks(rows):
    out = {"active": set(), "opened": set(), "premium": set()}
    for r in rows:
        if r["user_id"] is not None:
            key = (r["user_id"], FIRST + timedelta(days=(r["ts_ms"] - to_ms(FIRST)) // 86_400_000))
            out["active"].add(key)
            if r["event_type"] == "first_open":
                out["opened"].add(key)
            if r["subscription_status"] == "premium":
                out["premium"].add(key)
    return out


def bitmaps_of(spark, mart_of, rows, apart=30_000):
    """Users numbered far apart, so that they fill many buckets and stand at their edges."""
    users = sorted({r["user_id"] for r in rows} - {None})
    numbers = spark.createDataFrame([(u, 1 + i * apart + i % 3) for i, u in enumerate(users)], WIDE_APART)
    return ranges.user_bitmaps(mart_of(rows), numbers).cache()


def test_numbers_have_no_gaps_and_never_change(spark, mart_of, tmp_path):
    path = str(tmp_path / "numbers")
    ids = lambda names: mart_of([{"user_id": u, "ts_ms": 0} for u in names])
    first = {r.user_id: r.user_no for r in ranges.number_users(spark, ids([f"u{i}" for i in range(300)] + [None, "u3"]), path).collect()}
    assert sorted(first.values()) == list(range(1, 301))
    more = {r.user_id: r.user_no for r in ranges.number_users(spark, ids([f"u{i}" for i in range(250, 500)]), path).collect()}
    assert sorted(more.values()) == list(range(1, 501)) and first.items() <= more.items()
    assert ranges.number_users(spark, ids(["u1", None]), path).count() == 500
    assert ranges.number_users(spark, ids([]), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_users_of_any_range_equal_brute_force(spark, mart_of, seed):
    rows = events(seed)
    bits, truth = bitmaps_of(spark, mart_of, rows), marks(rows)
    for lo, hi in ((0, 42), (3, 3), (5, 20), (40, 60), (50, 60)):
        got = {r.segment: r.users for r in ranges.distinct_users(bits, day(lo), day(hi)).collect()}
        want = {s: len({u for u, d in m if day(lo) <= d <= day(hi)}) for s, m in truth.items()}
        assert got == {s: n for s, n in want.items() if n}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("as_of", [LAST, day(25)])
def test_rolling_users_equal_brute_force(spark, mart_of, seed, as_of):
    rows = events(seed, n=60)  # few, so that most buckets are silent on most days
    got = {(r.segment, r.d): (r.users_1, r.users_7, r.users_30) for r in ranges.rolling_users(bitmaps_of(spark, mart_of, rows), as_of).collect()}
    want = {}
    for s, m in marks(rows).items():
        for k in range((as_of - FIRST).days + 1):
            counts = tuple(len({u for u, d in m if day(k) - timedelta(days=n) < d <= day(k)}) for n in (1, 7, 30))
            if counts[2]:
                want[s, day(k)] = counts
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_cohorts_equal_brute_force(spark, mart_of, seed):
    rows = events(seed)
    truth = marks(rows)
    got = {r.d: (r.cohort_users, r.back_1, r.back_7, r.back_30) for r in ranges.cohort_returns(bitmaps_of(spark, mart_of, rows)).collect()}
    want = {}
    for d in {d for _, d in truth["opened"]}:
        own = {u for u, x in truth["opened"] if x == d}
        back = [sum((u, d + timedelta(days=h)) in truth["active"] for u in own) for h in (1, 7, 30)]
        want[d] = (len(own), *back)
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_returning_users_equal_brute_force(spark, mart_of, seed):
    rows = events(seed, n=80)
    bits, truth = bitmaps_of(spark, mart_of, rows), marks(rows)["active"]
    for lo, hi in ((0, 42), (10, 30), (41, 42), (50, 60)):
        days = {}
        for u, d in truth:
            if day(lo) <= d <= day(hi):
                days.setdefault(u, []).append(d)
        again = sum(any(timedelta(0) < d - min(ds) <= timedelta(days=7) for d in ds) for ds in days.values())
        got = ranges.returning_users(bits, day(lo), day(hi)).collect()
        assert [(r.returning_users, r.total_users) for r in got] == [(again, len(days))]


def test_windows_shuffle_the_bitmaps_once(spark, mart_of, tmp_path):
    bitmaps_of(spark, mart_of, events(0)).write.parquet(str(tmp_path / "b"))
    bits = spark.read.parquet(str(tmp_path / "b"))
    for df in (ranges.rolling_users(bits, LAST), ranges.cohort_returns(bits)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The second one holds a count a day.
        assert plan.count("Exchange hashpartitioning") == 2 and "SinglePartition" not in plan


def test_only_changed_days_need_new_bitmaps(spark, mart_of, tmp_path):
    rows, late = events(1), [{**r, "user_id": f"late{i}"} for i, r in enumerate(events(1, n=5))]
    path, known = str(tmp_path / "bitmaps"), str(tmp_path / "numbers")
    mart.write_mart(ranges.user_bitmaps(mart_of(rows), ranges.number_users(spark, mart_of(rows), known)), path)
    both = mart_of(rows + late)
    changed = {FIRST + timedelta(days=(r["ts_ms"] - to_ms(FIRST)) // 86_400_000) for r in late}
    fresh = both.where(ranges._day().isin(sorted(changed)))
    mart.write_mart(ranges.user_bitmaps(fresh, ranges.number_users(spark, fresh, known)), path)
    kept = spark.read.schema("bucket bigint, segment string, bits binary, year string, month string, day string").parquet(path)
    want = ranges.user_bitmaps(both, ranges.number_users(spark, both, known))
    columns = ["year", "month", "day", "bucket", "segment", F.hex("bits")]
    assert sorted(kept.select(*columns).collect()) == sorted(want.select(*columns).collect())


def rank_error(values, estimate, rank):
    lo, hi = bisect_left(values, estimate) / len(values), bisect_right(values, estimate) / len(values)
    return max(0.0, lo - rank, rank - hi)


def test_merged_sketches_keep_their_rank_error(spark):
    """40 days of 20,000 values each, of very unequal distributions."""
    rows = spark.range(800_000).selectExpr(
        "id % 40 AS k", "CASE WHEN id % 40 < 20 THEN pow(xxhash64(id) % 1000000 / 1e6, 3) * 100 ELSE 50 + id % 40 END AS duration"
    )
    rows = rows.selectExpr(
        "'performance' AS event_type", "duration", "date_add(DATE '2023-12-20', CAST(k AS INT)) AS d"
    ).selectExpr("*", "date_format(d, 'yyyy') AS year", "date_format(d, 'MM') AS month", "date_format(d, 'dd') AS day").cache()
    sketches = ranges.daily_sketches(rows).cache()
    assert sketches.agg(F.max(F.length("sketch"))).first()[0] < 40_000
    ranks = (0.05, 0.5, 0.95, 0.99)
    for lo, hi in ((0, 39), (15, 24), (7, 7)):
        values = sorted(r.duration for r in rows.where(F.col("d").between(day(lo), day(hi))).collect())
        for got in ranges.percentiles(sketches, day(lo), day(hi), ranks).collect():
            assert got.n == len(values)
            for r in ranks:
                assert rank_error(values, got[f"p{round(r * 1000):03d}"], r) < 0.01
    rolling = {r.d: r for r in ranges.rolling_percentiles(sketches).where("measure = 'load_time'").collect()}
    assert len(rolling) == 40 and rolling[day(3)].n == 80_000 and rolling[day(30)].n == 140_000
    values = sorted(r.duration for r in rows.where(F.col("d").between(day(24), day(30))).collect())
    assert rank_error(values, rolling[day(30)].p500, 0.5) < 0.01


def test_days_without_values_have_no_sketch(mart_of):
    rows = [{"user_id": "a", "ts_ms": to_ms(FIRST), "duration": None}, {"user_id": "a", "ts_ms": to_ms(day(1)), "duration": 2.0}]
    assert [(r.measure, r.day) for r in ranges.daily_sketches(mart_of(rows)).collect()] == [("session_duration", "21")]
    assert ranges.percentiles(ranges.daily_sketches(mart_of([])), FIRST, LAST).collect() == []


def test_a_mart_from_sketches_reads_its_events_once(mart_of):
    """With fewer values a day than ``k`` the sketches are exact, so the whole mart must be equal."""
    rows = mart_of(events(2))
    exact = mart.daily_metrics_mart(rows, LAST)
    once = mart.metrics_of(mart.facts(rows, LAST), ranges.sketched_percentiles(ranges.daily_sketches(rows)))
    assert once.collect() == exact.collect()
