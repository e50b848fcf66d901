"""Streams of the older generation: event-time timers over keyed JSON state. event_ts must be a TIMESTAMP."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from corvane.functions.schemas import PROFILE_FULL, SESSION_SUMMARY
from corvane.operators.legacy import Profile, Session, day

_STATE = StructType([StructField("json", StringType())])


def _ms(r: Row) -> int:
    return round(r["event_ts"].timestamp() * 1000)


class _Keyed(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", _STATE)

    def load(self) -> dict:
        return json.loads(self.kept.get()[0]) if self.kept.exists() else {}

    def save(self, state: dict) -> None:
        if state:
            self.kept.update((json.dumps(state),))
        else:
            self.kept.clear()

    def rearm(self, wanted: set[int]) -> None:
        """Timers as they should be: those that are no longer due go, new ones come."""
        there = set(self.handle.listTimers())
        for t in there - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - there:
            self.handle.registerTimer(t)

    def close(self) -> None:
        pass


class Sessions(_Keyed):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = Session(self.load())
        due = 0
        for r in sorted(rows, key=lambda r: r["seq"]):
            due = s.add(r.asDict(), _ms(r))
        mark = timerValues.getCurrentWatermarkInMs()
        if due <= mark:
            # All of it is late: it closes at the next step of the watermark.
            due = mark + 1
        self.rearm({due})
        self.save(s.state)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = Session(self.load())
        if s.state:
            yield _row(s.close(), SESSION_SUMMARY)
        self.save({})


class Profiles(_Keyed):
    def __init__(self, clock: Callable[[], int] | None = None) -> None:
        self.clock = clock or (lambda: int(time.time() * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        p, clock, last, fresh = Profile(self.load()), self.clock(), 0, False
        for r in sorted(rows, key=lambda r: r["seq"]):
            last = _ms(r)
            if p.add(r.asDict(), last, clock):
                yield _row(p.publish("create", "event", day(last), clock), PROFILE_FULL)
                fresh = False
            else:
                fresh = True
        if fresh:  # a batch's later events are published once: the trigger interval is the debounce
            yield _row(p.publish("update", "event", day(p.state["last_seen"]), clock), PROFILE_FULL)
        self.rearm({*p.timers.values()})
        self.save(p.state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        p = Profile(self.load())
        if p.state:
            for out in p.fire(expiredTimerInfo.getExpiryTimeInMs(), self.clock()):
                yield _row(out, PROFILE_FULL)
            self.rearm({*p.timers.values()})
            self.save(p.state)


def _row(values: dict, schema: StructType) -> Row:
    return Row(*schema.fieldNames())(*(values[c] for c in schema.fieldNames()))


def session_summaries(unified: DataFrame) -> DataFrame:
    """Keyed by session id; late rows extend or reopen a session."""
    rows = unified.withWatermark("event_ts", "5 seconds").where("session_id IS NOT NULL")
    return rows.groupBy("session_id").transformWithState(Sessions(), SESSION_SUMMARY, "Append", "EventTime")


def profiles(unified: DataFrame, clock: Callable[[], int] | None = None) -> DataFrame:
    """33 fields, keyed by canonical id alone; run it with a trigger of five seconds for the debounce."""
    rows = unified.withWatermark("event_ts", "5 seconds")
    return rows.groupBy("canonical_id").transformWithState(Profiles(clock), PROFILE_FULL, "Append", "EventTime")
