"""Views over a landed lake, and the named queries on them."""

from datetime import date

import pytest

from lakepulse import views
from lakepulse.operators.flatten import to_flat
from lakepulse.operators.predicates import between_days
from lakepulse.sources import fixture, sinks
from lakepulse.sources.fixture import AS_OF


@pytest.fixture(scope="module")
def tables(spark, tiny, tmp_path_factory):
    root = tmp_path_factory.mktemp("views")
    paths = {"analytics": str(root / "analytics"), "transactions": str(root / "transactions")}
    sinks.write_json(fixture.batches(spark, tiny), paths["analytics"], ["year", "month", "day"])
    sinks.write_json(fixture.transactions(spark, tiny), paths["transactions"], ["year", "month", "day"])
    return views.register_lake(spark, paths, min_year="2024")


def test_sql_over_the_views(spark, tiny, tables):
    n = spark.sql("SELECT count(*) n FROM flattened_analytics WHERE year = '2024' AND month = '01'").first().n
    assert n == fixture.flat(spark, tiny).count()
    assert spark.sql("SELECT sum(subscription_info.trial_period::int) s FROM transactions").first().s > 0


@pytest.mark.parametrize("name", views.NAMED_QUERIES)
def test_named_queries_run_on_the_landed_lake(spark, tiny, tables, name):
    landed = to_flat(tables["flattened_analytics"])
    got, want = views.run(name, landed, AS_OF), views.run(name, fixture.flat(spark, tiny), AS_OF)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_another_period(spark, tiny):
    flat = fixture.flat(spark, tiny)
    week = between_days(date(2024, 1, 8), date(2024, 1, 14))
    assert views.run("daily_active_users", flat, date(2030, 1, 1), period=week).count() == 7
    assert views.run("daily_active_users", flat, date(2030, 1, 1)).count() == 0


def test_daily_metrics_view(spark, tiny):
    views.register_daily_metrics(fixture.mart_events(fixture.flat(spark, tiny)), AS_OF, min_year="2024")
    assert spark.sql("SELECT sum(total_events) n FROM daily_metrics").first().n == fixture.flat(spark, tiny).count()


@pytest.mark.parametrize("name", views.EVENT_QUERIES)
def test_event_queries_run_by_name(spark, tiny, name):
    events = fixture.mart_events(fixture.flat(spark, tiny))
    assert views.run(name, events, AS_OF).count() > 0
    assert views.run(name, events, date(2030, 1, 1)).count() == 0


@pytest.mark.parametrize("name", ["response_trend_analysis", "new_vs_returning_users", "user_wellness_journey"])
def test_the_day_bounds_what_is_read(spark, tiny, name):
    flat = fixture.flat(spark, tiny)
    assert views.run(name, flat, AS_OF).count() > 0
    assert views.run(name, flat, date(2030, 1, 1)).count() == 0
