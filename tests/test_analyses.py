"""Hand-worked cases of the other analyses."""

from datetime import date, datetime

import pytest

from lakepulse.plans import activity, churn, engagement, focus, responses, sessions

AS_OF = date(2024, 1, 31)
DONE = "anxiety_session_completed"


def days(device, *active, kind="screen_view", each=1):
    return [{"device_id": device, "event_type": kind, "at": f"2024-01-{d:02d}T08:00:00"} for d in active for _ in range(each)]


@pytest.mark.parametrize(
    ("last", "risk"), [(31, "Active"), (29, "Active"), (28, "Low Risk"), (25, "Low Risk"), (24, "Medium Risk"),
                       (18, "Medium Risk"), (17, "High Risk")],
)
def test_churn_risk_edges(flat_of, last, risk):
    row = churn.user_lifecycle(flat_of(days("a", last)), AS_OF).first()
    assert row.churn_risk_level == risk
    assert row.retention_score == max(0, 100 - 5 * (31 - last) - 30)


@pytest.mark.parametrize(
    ("first", "stage"),
    [("2024-01-24", 0), ("2024-01-23", 1), ("2024-01-01", 1), ("2023-12-31", 2), ("2023-11-02", 2), ("2023-11-01", 3)],
)
def test_lifecycle_edges_need_history(flat_of, first, stage):
    flat = flat_of([{"at": f"{first}T01:00:00"}, {"at": "2024-01-31T01:00:00"}])
    assert churn.user_lifecycle(flat, AS_OF, history_months=4).first().user_lifecycle_stage == churn.STAGES[stage]
    if stage > 1:  # the current month alone cannot show it
        assert churn.user_lifecycle(flat, AS_OF).first().user_lifecycle_stage == churn.STAGES[0]


@pytest.mark.parametrize(
    ("completed", "active", "level"),
    [(10, 7, "Highly Engaged"), (10, 6, "Moderately Engaged"), (5, 3, "Moderately Engaged"), (5, 2, "Lightly Engaged"),
     (1, 1, "Lightly Engaged"), (0, 7, "Minimal Engagement")],
)
def test_engagement_level_edges(flat_of, completed, active, level):
    rows = days("a", *range(20, 20 + active)) + days("a", 20, kind=DONE, each=completed)
    assert churn.user_lifecycle(flat_of(rows), AS_OF).first().engagement_level == level


def test_consistency_penalty(flat_of):
    sparse = churn.user_lifecycle(flat_of(days("a", 1, 31, kind=DONE)), AS_OF).first()
    assert (sparse.total_active_days, sparse.days_since_first_use) == (2, 31)
    assert sparse.retention_score == 80  # 6.5 % of days active


def test_small_cohorts_are_left_out_before_shares(flat_of):
    rows = [r for d in "abcd" for r in days(d, 31)] + days("e", 10) + days("f", 10)
    got = churn.retention_churn(flat_of(rows), AS_OF).collect()
    assert [(r.user_count, r.percentage_of_cohort, r.recommended_action) for r in got] == [
        (4, 100.0, "Onboarding Optimization")
    ]


def test_daily_users_with_null_ids(flat_of):
    rows = [
        {"device_id": "a", "event_type": DONE},
        {"device_id": "a", "event_type": "screen_view"},
        {"device_id": None, "session_id": None, "event_type": DONE},
        {"device_id": "b", "event_type": "app_background"},
    ]
    r = activity.daily_active_users(flat_of(rows), AS_OF).first()
    got = (r.daily_active_users, r.daily_unique_sessions, r.total_events, r.sessions_with_anxiety_completion)
    assert got == (2, 2, 4, 1)
    assert (r.anxiety_completion_events, r.events_per_user, r.session_completion_rate) == (2, 2.0, 50.0)


def test_a_session_shared_by_two_devices_counts_once(flat_of):
    rows = [{"device_id": d, "session_id": "s", "event_type": DONE} for d in "ab"]
    r = activity.daily_active_users(flat_of(rows), AS_OF).first()
    assert (r.daily_active_users, r.daily_unique_sessions, r.sessions_with_anxiety_completion) == (2, 1, 1)
    t = sessions.treatment_completion(flat_of(rows), AS_OF).first()
    assert (t.total_sessions, t.total_users, t.full_session_completion_rate_percent) == (1, 2, 200.0)


def test_timing_labels(flat_of):
    hours = {5: "Night (10pm-5am)", 6: "Morning (6-11am)", 11: "Morning (6-11am)", 12: "Afternoon (12-5pm)",
             17: "Afternoon (12-5pm)", 18: "Evening (6-9pm)", 21: "Evening (6-9pm)", 22: "Night (10pm-5am)"}
    rows = [
        {"device_id": "a", "event_type": DONE, "danger_level": "8", "at": f"2024-01-07T{h:02d}:00:00"} for h in hours
    ]
    got = focus.session_timing(flat_of(rows), AS_OF).collect()
    hourly = [(int(r.time_dimension), r.time_category) for r in got if r.analysis_type == "Hourly Analysis"]
    assert hourly == list(hours.items())
    daily = [r for r in got if r.analysis_type == "Daily Analysis"]
    assert [(r.time_dimension, r.time_category) for r in daily] == [("Sunday", "Weekend")]
    assert got[0].analysis_type == "Daily Analysis"
    # Events over sessions: the share can exceed 100.
    assert daily[0].high_anxiety_percentage == 800.0


def test_hours_without_completions_are_left_out(flat_of):
    assert focus.session_timing(flat_of([{"event_type": "screen_view"}]), AS_OF).count() == 0


def test_funnel_of_an_empty_lake(flat_of):
    rows = sessions.user_journey_funnel(flat_of([{"event_type": "click"}]), AS_OF).collect()
    assert [(r.users, r.conversion_rate) for r in rows] == [(0, 100.0), (0, None), (0, None)]


def test_flow_without_any_step_has_no_rates(flat_of):
    row = sessions.anxiety_flow_effectiveness(flat_of([{"event_type": DONE}]), AS_OF).first()
    assert (row.total_anxiety_sessions, row.session_completion_rate_percent) == (1, 100.0)
    assert row.reduce_response_rate_percent is None and row.high_danger_rate_percent is None


def test_flow_patterns_need_five(flat_of):
    rows = []
    for i in range(9):
        kinds = {"danger_level_selected": {"danger_level": "High"}, "probability_level_selected": {"probability_level": "Low"},
                 "response_selected": {"response": "Reduce" if i < 5 else "Maintain"}}
        rows += [{"device_id": f"d{i}", "event_type": k} | v for k, v in kinds.items()]
    got = {r.metric_type: r for r in sessions.anxiety_flow_effectiveness(flat_of(rows), AS_OF).collect()}
    pattern = got["Response Pattern: High danger, Low prob → Reduce"]
    assert len(got) == 2
    assert (pattern.total_anxiety_sessions, pattern.focus_selection_rate_percent) == (5, 55.6)
    assert got["Anxiety Flow Effectiveness"].high_danger_rate_percent == 100.0


def levels(device, *values, response="Reduce"):
    return [
        {"device_id": device, "event_type": DONE, "danger_level": str(v), "probability_level": "5", "response": response,
         "focus": "Work", "at": f"2024-01-{i + 1:02d}T00:00:00"}
        for i, v in enumerate(values)
    ]


@pytest.mark.parametrize(
    ("values", "rating"),
    [((5, 4), "Highly Effective"), ((5, 5, 4), "Effective"), ((5, 5), "Neutral"), ((5, 6), "Concerning"), ((5,), None)],
)
def test_response_ratings(flat_of, values, rating):
    row = responses.response_effectiveness(flat_of(levels("a", *values))).first()
    assert row.response_effectiveness_rating == rating
    assert row.total_response_events == len(values)


def test_trend_covers_five_sessions(flat_of):
    got = responses.response_trend(flat_of(levels("a", 1, 2, 4, 7, 11, 16, 22))).orderBy("ms").collect()
    assert [r.danger_change for r in got] == [1, 2, 3, 4, 5, 6, None]
    assert [r.recent_effectiveness_trend for r in got] == [1, 1.5, 2, 2.5, 3, 4, 4.5]


def test_anxiety_trend(flat_of):
    got = responses.anxiety_trend(flat_of(levels("a", 9, 6, 3, 3))).orderBy("session_number").collect()
    assert [(r.moving_avg_danger, r.change_from_first) for r in got] == [(9, 0), (7.5, -3), (6, -6), (4, -6)]


def test_weeks_start_on_monday(flat_of):
    rows = levels("a", *[4] * 14)  # 1 January 2024 is a Monday
    got = responses.wellness_journey(flat_of(rows)).orderBy("week_start").collect()
    assert [(r.week_start, r.sessions, r.sessions_change) for r in got] == [
        (date(2024, 1, 1), 7, None), (date(2024, 1, 8), 7, 0)
    ]


def test_user_engagement_levels(flat_of):
    rows = [r for d, n in {"a": 0, "b": 1, "c": 2, "d": 4, "e": 5}.items()
            for r in days(d, 3) + days(d, 4, kind=DONE, each=n)]
    got = {r.device_id: r.engagement_level.split()[0] for r in activity.user_engagement(flat_of(rows), AS_OF).collect()}
    assert got == {"a": "No", "b": "Low", "c": "Medium", "d": "Medium", "e": "High"}


def test_dau_alerts(flat_of):
    rows = [r for d in "abcde" for r in days(d, 1, kind=DONE, each=15)] + [r for d in "abc" for r in days(d, 2)]
    first, second = activity.dau_alerts(flat_of(rows), AS_OF).collect()
    assert first.previous_users is None and first.alert_user_drop == 0 and first.alert_low_engagement == 0
    assert (second.user_change_percent, second.alert_user_drop) == (-40.0, 1)
    assert second.alert_no_completions == second.alert_low_completion == second.alert_low_engagement == 1


def test_new_and_returning(flat_of):
    got = activity.new_vs_returning(flat_of(days("a", 1, 2) + days("b", 2))).collect()
    assert [(r.new_users, r.returning_users) for r in got] == [(1, 0), (1, 1)]


def test_session_based_engagement_bounds(flat_of):
    rows = [
        {"device_id": "a", "session_id": "s1", "at": "2024-01-30T19:00:00"},  # exactly one hour before: out
        {"device_id": "b", "session_id": "s2", "at": "2024-01-30T19:00:01"},
        {"device_id": "c", "session_id": "s3", "at": "2024-01-30T20:00:00"},
        {"device_id": "d", "session_id": "s4", "at": "2024-01-30T20:00:01"},  # later: out
        {"device_id": "e", "session_id": "s5", "at": "2024-01-29T19:30:00"},
    ]
    r = engagement.session_based(flat_of(rows), datetime(2024, 1, 30, 20)).first()
    assert (r.active_sessions, r.daily_active_users, r.engagement_score) == (2, 3, 66.67)


def test_session_based_engagement_over_midnight(flat_of):
    rows = [{"device_id": "a", "session_id": "s1", "at": "2024-01-29T23:45:00"}, {"device_id": "b", "at": "2024-01-30T00:10:00"}]
    r = engagement.session_based(flat_of(rows), datetime(2024, 1, 30, 0, 30)).first()
    assert (r.active_sessions, r.daily_active_users) == (2, 1)


def test_retention_based_engagement(flat_of):
    rows = days("a", 1, 8) + days("b", 1, 9) + days("c", 1) + days("d", 5, 5)
    r = engagement.retention_based(flat_of(rows)).first()
    assert (r.returning_users, r.total_users, r.engagement_score) == (1, 4, 25.0)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_results_do_not_depend_on_partitioning(spark, tiny, parts):
    from lakepulse.plans.risk import crisis_intervention
    from lakepulse.sources.fixture import flat

    rows = flat(spark, tiny)
    mixed = rows.repartition(parts)
    for f in (activity.daily_active_users, crisis_intervention, churn.retention_churn, focus.focus_sessions):
        assert f(mixed, AS_OF).collect() == f(rows, AS_OF).collect()


def test_an_unrelated_month_changes_nothing(flat_of):
    rows = [r for d in "abc" for r in days(d, 3, 9)]
    other = [{"device_id": "z", "at": "2023-01-05T00:00:00"}]
    for f in (activity.daily_active_users, activity.event_type_overview, churn.retention_churn, sessions.session_engagement):
        assert f(flat_of(rows), AS_OF).collect() == f(flat_of(rows + other), AS_OF).collect()
