"""Expressions and filters against hand-worked values."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import ms
from lakepulse.functions import exprs as X
from lakepulse.operators import predicates as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rounding_is_half_up(spark):
    cases = {0.125: 0.13, 2.675: 2.68, 1.005: 1.0, -0.125: -0.12, 0.0: 0.0, 1e7 + 0.005: 10000000.01}
    for value, want in cases.items():
        assert one(spark, X.round_half_up(F.lit(value), 2)) == want


def test_rounding_keeps_large_values(spark):
    for value in (5.0e13, -5.0e13, 1.5e300, float("inf")):
        assert one(spark, X.round_half_up(F.lit(value), 6)) == value
    assert one(spark, X.round_half_up(F.lit(52_050_000_000_000).cast("bigint"), 6)) == 5.205e13


def test_zero_divisors_give_null(spark):
    assert one(spark, X.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, X.percent(F.lit(1), F.lit(None).cast("int"))) is None
    assert one(spark, X.percent(F.lit(1), F.lit(3))) == 33.33


def test_text_levels_are_not_numbers(spark):
    assert one(spark, X.number(F.lit("Very High"))) is None
    assert one(spark, X.number(F.lit("7"))) == 7.0


@pytest.mark.parametrize(
    ("at", "hour", "dow", "name"),
    [
        ("2024-01-07T23:59:59", 23, 7, "Sunday"),
        ("2024-01-08T00:00:00", 0, 1, "Monday"),
        ("1969-12-31T23:00:00", 23, 3, "Wednesday"),
    ],
)
def test_dates_from_epoch(spark, at, hour, dow, name):
    t = F.lit(ms(at))
    assert one(spark, X.ms_date(t)) == date.fromisoformat(at[:10])
    assert one(spark, X.ms_hour(t)) == hour
    assert one(spark, X.iso_weekday(X.ms_date(t))) == dow
    assert one(spark, X.weekday_name(X.iso_weekday(X.ms_date(t)))) == name


def test_month_is_zero_padded(flat_of):
    flat = flat_of([{"at": "2024-01-03T00:00:00"}, {"at": "2023-12-31T00:00:00"}, {"at": "2023-11-30T00:00:00"}])
    assert flat.where(P.current_period(date(2024, 1, 20))).count() == 1
    assert flat.where(P.current_period(date(2024, 1, 20), history_months=2)).count() == 2
    assert flat.where(P.current_period(date(2025, 1, 20))).count() == 0


@pytest.mark.parametrize(
    ("start", "end", "n"),
    [
        (date(2024, 1, 1), date(2024, 1, 31), 31),
        (date(2023, 12, 30), date(2024, 2, 2), 35),
        (date(2024, 2, 28), date(2024, 3, 1), 3),
        (date(2024, 1, 5), date(2024, 1, 5), 1),
        (date(2024, 1, 5), date(2024, 1, 4), 0),
    ],
)
def test_between_days_equals_the_calendar(spark, start, end, n):
    days = spark.sql("select explode(sequence(date'2023-11-01', date'2024-04-30')) d").selectExpr(
        "d", "date_format(d, 'yyyy') year", "date_format(d, 'MM') month", "date_format(d, 'dd') day"
    )
    got = {r.d for r in days.where(P.between_days(start, end)).collect()}
    assert len(got) == n and all(start <= d <= end for d in got)


def test_last_days_keeps_events_filed_a_day_early(flat_of):
    rows = [
        {"at": "2024-01-01T00:00:00"},
        {"at": "2023-12-31T23:59:59"},
        {"at": "2024-01-01T00:00:01", "year": "2023", "month": "12", "day": "31"},
    ]
    assert flat_of(rows).where(P.last_days(date(2024, 1, 31), 30)).count() == 2


def test_like_is_case_sensitive_and_null_safe(flat_of):
    rows = [{"focus": f} for f in ("my crisis", "Crisis", None, "self-harm", "emergency room", "work")]
    assert flat_of(rows).where(P.contains_any("focus", ["crisis", "emergency", "harm"])).count() == 3


def test_empty_text_is_not_filled(flat_of):
    assert flat_of([{"screen_name": s} for s in ("", None, "Home")]).where(P.filled("screen_name")).count() == 1


def test_time_slices(flat_of):
    rows = [
        {"at": "2024-01-06T17:00:00"},  # Saturday
        {"at": "2024-01-07T18:00:00"},  # Sunday
        {"at": "2024-01-08T09:00:00"},  # Monday
        {"at": "2024-01-08T17:59:59"},
        {"at": "2024-01-08T21:59:59"},
        {"at": "2024-01-08T22:00:00"},
    ]
    flat = flat_of(rows)
    counts = [flat.where(P.in_time_slice(s)).count() for s in ("peak", "weekend", "business")]
    assert counts == [2, 2, 2]


def test_exact_mean_does_not_depend_on_partitions(spark):
    rows = [(k, 0.01 * k + 1e6 * (k % 7 == 0)) for k in range(5_000)] + [(None, None)]
    df = spark.createDataFrame(rows, "k int, x double")
    found = {df.repartition(n, "k").agg(X.exact_mean("x").alias("m")).first().m for n in (1, 3, 16, 200)}
    assert len(found) == 1 and found.pop() == pytest.approx(sum(x for _, x in rows[:-1]) / 5_000, rel=1e-12)
    assert df.where("k < 0").agg(X.exact_mean("x").alias("m")).first().m is None
