from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from corvane.functions.schemas import PROFILE_FULL, SESSION_SUMMARY
from corvane.operators.legacy import DAY_MS, GAP_MS, Profile, Session
from corvane.sources import readers
from corvane.streaming import legacy
from tests.test_streaming import at, collect, feed


def ms(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp() * 1000)


NOON = ms("2024-01-10 12:00:00")


def event(**more):
    return {"canonical_id": "c", "tenant_id": "t", "event_type": "click", **more}


def test_session_keeps_first_arrival_and_last_values_by_arrival():
    s = Session()
    s.add(event(session_id="s", browser="b1"), NOON + 5000)
    due = s.add(event(session_id="s", browser="b2", page_url="/x", canonical_id="other"), NOON)
    out = s.close()
    assert due == NOON + 5000 + GAP_MS and list(out) == SESSION_SUMMARY.fieldNames()
    assert (out["canonical_id"], out["browser"], out["duration_sec"], out["event_types"]) == ("c", "b2", 0, {"click": 2})
    assert out["start_time"].endswith("12:00:05.000") and s.state == {}


def test_profile_create_update_and_changed_fields():
    p = Profile()
    assert p.add(event(session_id="s1"), NOON, NOON)
    first = p.publish("create", "event", "2024-01-10", NOON)
    assert sorted(first) == sorted(PROFILE_FULL.fieldNames()) and len(first) == 33 and first["changed_fields"][0] == "canonical_id"
    assert not p.add(event(event_type="page_view", page_url="/a", session_id="s1"), NOON + 1000, NOON)
    assert p.publish("update", "event", "2024-01-10", NOON)["changed_fields"] == ["total_events", "last_seen", "page_views", "last_page"]


def test_transitions_timeout_and_decay():
    p = Profile()
    for k, sid in enumerate(["A", "A", "B", "A", None, "", "A"]):
        p.add(event(session_id=sid), NOON + k * 1000, NOON)
    assert p.state["sessions"] == 3 and p.timers == {"session": NOON + 6000 + GAP_MS}
    (out,) = p.fire(NOON + 6000 + GAP_MS, NOON)
    assert (out["trigger"], out["avg_session_duration_sec"], out["current_session_active"], out["events_1d"]) == ("session_timeout", 3, False, 7)
    assert sorted(p.timers.values()) == [NOON + 6000 + n * DAY_MS for n in (1, 7, 30)]
    (out,) = p.fire(NOON + 6000 + DAY_MS, NOON)
    assert (out["trigger"], out["events_1d"], out["events_7d"]) == ("window_decay_1d", 0, 7)
    p.add(event(session_id="C"), NOON + 2 * DAY_MS, NOON + 2 * DAY_MS)
    assert list(p.timers) == ["session"]  # activity calls off the other decays


def test_a_timeout_forgets_the_session_and_events_without_one_lengthen_it():
    p = Profile()
    p.add(event(session_id="s"), NOON, NOON)
    p.add(event(session_id=None), NOON + 60_000, NOON)
    (out,) = p.fire(NOON + 60_000 + GAP_MS, NOON)
    assert (out["avg_session_duration_sec"], out["total_sessions"]) == (60, 1)
    p.add(event(session_id="s"), NOON + DAY_MS, NOON + DAY_MS)
    out = p.publish("update", "event", "2024-01-11", NOON + DAY_MS)
    assert (out["total_sessions"], out["current_session_active"]) == (2, True)
    assert out["changed_fields"] == ["total_events", "total_sessions", "last_seen", "clicks"]


def test_times_beyond_reason_are_the_clocks():
    p = Profile()
    p.add(event(), NOON + 61_000, NOON)
    p.add(event(), NOON - 92 * DAY_MS, NOON)
    assert p.state["first_seen"] == p.state["last_seen"] == NOON and p.state["days"] == {"2024-01-10": 2}


def test_session_deadline_follows_the_current_event_even_an_older_one():
    p = Profile()
    p.add(event(session_id="s"), NOON, NOON)
    p.add(event(session_id="s"), NOON - 10_000, NOON)
    assert p.timers["session"] == NOON - 10_000 + GAP_MS and p.state["last_seen"] == NOON


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = [at("00:00:00.000"), at("00:10:00.000", session_id="s", page_url="/a"), at("02:00:00.000", session_id="z", anonymous_id="b"), at("04:00:00.000", session_id="y", anonymous_id="b")]
    path = feed(tmp_path / "in", rows)
    stream = lambda: readers.with_time(readers.json_stream(spark, path), zoned=True).withColumns({"seq": F.col("event_id").cast("long"), "canonical_id": F.col("anonymous_id")})
    got = collect(spark, legacy.session_summaries(stream()), tmp_path, "legacy_sessions")
    assert [(r["session_id"], r["duration_sec"], r["event_count"]) for r in sorted(got, key=lambda r: r["end_time"])][:1] == [("s", 600, 2)]
    clock = ms("2024-01-01 04:00:00")
    told = collect(spark, legacy.profiles(stream(), lambda: clock), tmp_path, "legacy_profiles")
    of_a = [(r["action"], r["trigger"], r["total_events"], r["avg_session_duration_sec"]) for r in told if r["canonical_id"] == "a"]
    assert of_a == [("create", "event", 1, 0), ("update", "event", 2, 0), ("update", "session_timeout", 2, 600)]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
