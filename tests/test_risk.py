"""Risk report at each threshold."""

from datetime import date

import pytest

from lakepulse.plans.risk import crisis_intervention

DONE = "anxiety_session_completed"


def device(name, levels, last="2024-01-31", **more):
    """Completed sessions, oldest first, one hour apart on the last day."""
    return [
        {
            "device_id": name, "event_type": DONE, "danger_level": str(v), "probability_level": "5",
            "response": "Reduce", "focus": "Work", "at": f"{last}T{i:02d}:00:00",
        } | more
        for i, v in enumerate(levels)
    ]


def report(flat, as_of=date(2024, 1, 31)):
    return {r.device_id: r for r in crisis_intervention(flat, as_of).collect()}


@pytest.mark.parametrize(
    ("levels", "level", "score"),
    [
        ([1, 1, 9], "CRITICAL", 4 + 0 + 2 + 1),
        ([1, 1, 8], "HIGH", 3 + 0 + 2),
        ([1, 1, 7], "MODERATE", 2),
        ([1, 1, 6], "ELEVATED", 1),
        ([1, 1, 5], None, None),
        ([8, 8, 1], "CRITICAL", 0 + 0 + 3),  # two of the last three at 8 or more
        ([9, 9, 1, 1, 1], "HIGH", 1),  # two extreme sessions, long past
        ([9, 1, 1, 1, 1], None, None),
        ([9, 9, 9, 1, 1, 1], "HIGH", 2),
        ([7, 7, 7], "MODERATE", 2 + 2),  # average 7
        ([6, 6, 6], "ELEVATED", 1 + 1),
        ([8, 8, 8, 8, 8, 1, 1, 1], "MODERATE", 0),  # five high sessions
        ([8, 8, 8, 1, 1, 1], "ELEVATED", 0),  # three high sessions
        ([10, 10, 10], "CRITICAL", 4 + 3 + 3 + 2),
        ([9], None, None),  # one session is not enough
    ],
)
def test_level_and_score(flat_of, levels, level, score):
    row = report(flat_of(device("d", levels))).get("d")
    assert (row and row.risk_level, row and row.risk_score) == (level, score)


def test_maximum_score_and_responses(flat_of):
    rows = device("d", [10, 10, 10], response="Increase", focus="crisis support")
    row = report(flat_of(rows))["d"]
    assert (row.risk_score, row.crisis_focus_sessions, row.concerning_increase_responses) == (17, 3, 3)


def test_crisis_focus_alone_is_critical(flat_of):
    rows = device("d", [1, 1, 1])
    rows[0]["focus"] = "self-harm"
    row = report(flat_of(rows))["d"]
    assert (row.risk_level, row.risk_score) == ("CRITICAL", 3)


@pytest.mark.parametrize(
    ("last", "days", "recency", "advice"),
    [
        ("2024-01-31", 0, "Active Today", "IMMEDIATE ATTENTION NEEDED"),
        ("2024-01-30", 1, "Recent Activity", "IMMEDIATE ATTENTION NEEDED"),
        ("2024-01-29", 2, "Moderately Recent", "Monitor"),
        ("2024-01-28", 3, "Moderately Recent", "Monitor"),
        ("2024-01-24", 7, "Week Ago", "Monitor"),
        ("2024-01-23", 8, "Inactive >7 days", "Monitor"),
    ],
)
def test_urgency_of_a_critical_device(flat_of, last, days, recency, advice):
    row = report(flat_of(device("d", [9, 9], last)))["d"]
    got = (row.days_since_last_session, row.activity_recency, row.intervention_recommendation)
    assert got == (days, recency, advice)


@pytest.mark.parametrize(
    ("levels", "last", "advice"),
    [
        ([1, 1, 8], "2024-01-29", "Priority Follow-up"),
        ([1, 1, 8], "2024-01-28", "Monitor"),
        ([1, 1, 7], "2024-01-28", "Check-in Recommended"),
        ([1, 1, 7], "2024-01-27", "Monitor"),
        ([1, 1, 6], "2024-01-30", "Monitor"),
        ([1, 1, 6], "2024-01-29", None),  # elevated is listed for a day only
    ],
)
def test_urgency_of_lower_levels(flat_of, levels, last, advice):
    row = report(flat_of(device("d", levels, last))).get("d")
    assert (row and row.intervention_recommendation) == advice


def test_only_known_levels_of_the_month_count(flat_of):
    rows = device("d", [9, 9], "2023-12-31") + device("d", ["High", 9], "2024-01-30") + device("e", [9, 9], "2024-01-30")
    assert set(report(flat_of(rows))) == {"e"}


def test_recent_focus_mode_breaks_ties_by_name(flat_of):
    rows = device("d", [9] * 7)
    for row, focus in zip(rows, ["Z", "Z", "Work", "Sleep", "Work", "Sleep", None], strict=True):
        row["focus"] = focus
    row = report(flat_of(rows))["d"]  # the last five: Work, Sleep, Work, Sleep, NULL
    assert row.recent_primary_focus == "Sleep"


def test_equal_times_are_ordered_by_event(flat_of):
    rows = device("d", [7, 9])
    for r, name in zip(rows, ("b", "a"), strict=True):
        r |= {"at": "2024-01-31T00:00:00", "event_id": name}
    assert report(flat_of(rows))["d"].latest_danger_level == 7.0
