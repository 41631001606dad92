import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

FLAT = (
    "event_id string, device_id string, session_id string, event_type string, event_timestamp string, "
    "screen_name string, danger_level string, probability_level string, response string, focus string, "
    "specific_focus string, duration double, year string, month string, day string"
)
MART = (
    "user_id string, session_id string, event_type string, event_name string, ts_ms bigint, duration double, "
    "screen_name string, subscription_status string, device_type string, app_version string, country string, "
    "year string, month string, day string"
)


@pytest.fixture(scope="session")
def spark():
    from lakepulse.session import local_session

    session = local_session(shuffle_partitions=4, app="lakepulse-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


def ms(text: str) -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1000)


def _frame(spark, ddl, rows):
    names = [f.strip().split(" ")[0] for f in ddl.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


@pytest.fixture(scope="session")
def flat_of(spark):
    """Event rows from short dicts: ``at`` (ISO text) fills the time and partition columns."""

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            at = r.get("at", "2024-01-15T12:00:00")
            device = r.get("device_id", "a")
            base = {
                "event_id": f"e{i:04d}", "device_id": device, "session_id": f"{device}-{at[:10]}",
                "event_timestamp": str(ms(at)), "year": at[:4], "month": at[5:7], "day": at[8:10],
            }
            full.append(base | {k: v for k, v in r.items() if k != "at"})
        return _frame(spark, FLAT, full)

    return build


@pytest.fixture(scope="session")
def mart_of(spark):
    def build(rows):
        full = []
        for r in rows:
            day = datetime.fromtimestamp(r["ts_ms"] / 1000, timezone.utc)
            base = {"event_type": "screen_view", "year": f"{day:%Y}", "month": f"{day:%m}", "day": f"{day:%d}"}
            full.append(base | r)
        return _frame(spark, MART, full)

    return build
