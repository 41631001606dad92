"""Alarm states on a stream: each series has a state machine, and event-time timers step it through windows without data."""

from __future__ import annotations

import json
import math
import operator
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakepulse.operators.alarms import MISSING

_COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
#: next window, breaches of the last windows, last known state, windows that wait (JSON)
_STATE = "next bigint, recent string, known string, waiting string"
_ROWS = 10_000


class Machine:
    """The alarm of one series, a window at a time; the rules are those of ``operators.alarms.alarm_states``."""

    def __init__(self, comparison: str, threshold: float, n_periods: int, missing: str, recent: list, known: str | None) -> None:
        self.compare, self.threshold, self.n_periods, self.missing = _COMPARE[comparison], threshold, n_periods, missing
        self.recent, self.known = deque(recent, maxlen=n_periods), known

    def step(self, value: float | None) -> tuple[int | None, str]:
        """Whether a window breaches (None: no data), and the state behind it."""
        breach = None if value is None else int(self.compare(value, self.threshold))
        if breach is None and self.missing in ("notBreaching", "breaching"):
            breach = int(self.missing == "breaching")
        self.recent.append(breach)
        alarm = len(self.recent) == self.n_periods and all(b == 1 for b in self.recent)
        if self.missing == "ignore":
            if breach is not None:
                self.known = "ALARM" if alarm else "OK"
            return breach, self.known or "INSUFFICIENT_DATA"
        if self.missing == "missing" and all(b is None for b in self.recent):
            return breach, "INSUFFICIENT_DATA"
        return breach, "ALARM" if alarm else "OK"


def alarm_state_stream(
    series: DataFrame,
    period_s: int,
    comparison: str,
    threshold: float,
    n_periods: int,
    missing: str = "missing",
    by: list[str] | None = None,
    delay: str = "0 seconds",
) -> DataFrame:
    """``*by, window_start, value, breach, state`` for each window of a streamed series (``*by, window_start, value``).

    A window is judged once the watermark, the newest window of any series less ``delay``, has reached it; windows of one
    series may come in any order until then. From its first window on a series has a row for every window, so a series that
    falls silent goes on to be judged while others move the watermark: its timer is set to its next window. The state of
    a series is a few numbers and the windows that wait. Rows without a time are left out; NaN is no data.
    """
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    by, step = by or [], period_s * 1000

    def judge(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, recent, known, waiting = state.get if state.exists else (None, "[]", None, "[]")
        machine = Machine(comparison, threshold, n_periods, missing, json.loads(recent), known)
        held = dict(json.loads(waiting))
        if not state.hasTimedOut:
            for chunk in chunks:
                values = (None if v is None or math.isnan(v) else float(v) for v in chunk["value"])
                held |= dict(zip(map(int, chunk["window_start"]), values, strict=True))
        reached = state.getCurrentWatermarkMs()
        if following is None and held and min(held) <= reached:
            following = min(held)
        rows = []
        while following is not None and following <= reached:
            value = held.pop(following, None)
            rows.append((*key[: len(by)], following, value, *machine.step(value)))
            following += step
            if len(rows) == _ROWS:
                yield _frame(rows)
                rows = []
        state.update((following, json.dumps(list(machine.recent)), machine.known, json.dumps(list(held.items()))))
        first = following if following is not None else min(held, default=reached + 2)
        state.setTimeoutTimestamp(max(first - 1, reached + 1))  # a timer fires when the watermark is beyond it
        if rows:
            yield _frame(rows)

    names = [*by, "window_start", "value", "breach", "state"]

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"value": "Float64", "breach": "Int32"})

    types = {f.name: f.dataType.simpleString() for f in series.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "window_start bigint", "value double", "breach int", "state string"])
    timed = series.where("window_start IS NOT NULL").select(*by, "window_start", F.col("value").cast("double"), F.timestamp_millis("window_start").alias("at"))
    if not by:
        timed = timed.withColumn("all", F.lit(0))
    grouped = timed.withWatermark("at", delay).groupBy(*(by or ["all"]))
    return grouped.applyInPandasWithState(judge, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
