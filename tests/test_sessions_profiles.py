from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvane.operators import admission, profiles, sessions

COLUMNS = "event_id string, tenant_id string, canonical_id string, session_id string, event_type string, user_id string, page_url string, feature_name string, device_type string, browser string, country string, event_ts timestamp_ntz, seq bigint"


def events(spark, rows):
    """rows: dicts; arrival order is the list's."""
    base = {"tenant_id": "t", "canonical_id": "c", "session_id": "s", "event_type": "click", "user_id": None, "page_url": None, "feature_name": None, "device_type": None, "browser": None, "country": None}
    data = [{**base, "event_id": str(k), "seq": k, **r, "event_ts": datetime.fromisoformat(r["event_ts"])} for k, r in enumerate(rows)]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(d[c] for c in names) for d in data], COLUMNS)


def at(text):
    return {"event_ts": f"2024-01-01 {text}"}


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_five_second_cutoff(spark, chunk):
    df = events(spark, [at("00:00:10.000"), at("00:00:05.000"), at("00:00:04.999"), at("00:00:12.000")])
    kept = admission.admit(df, chunk=chunk)
    s = sessions.summaries(sessions.windows(kept)).first()
    assert (s["start_time"], s["end_time"], s["duration_sec"], s["event_count"]) == ("2024-01-01 00:00:05.000", "2024-01-01 00:00:12.000", 7, 3)


def test_gap_of_thirty_minutes_joins_and_one_more_millisecond_splits(spark):
    df = events(spark, [at("00:00:00.000"), at("00:30:00.000"), at("01:00:00.001")])
    assert sorted(r["event_count"] for r in sessions.windows(df).collect()) == [1, 2]


def test_tenants_and_empty_ids(spark):
    df = events(spark, [at("00:00:00.000"), {**at("00:00:01.000"), "tenant_id": "u"}, {**at("00:00:02.000"), "session_id": ""}, {**at("00:00:02.000"), "session_id": None}])
    assert sorted((r["tenant_id"], r["event_count"]) for r in sessions.windows(df).collect()) == [("t", 1), ("u", 1)]


def test_earliest_identity_latest_attributes_ties_by_arrival(spark):
    rows = [
        {**at("00:00:05.000"), "canonical_id": "later", "browser": "old"},
        {**at("00:00:01.000"), "canonical_id": "first", "browser": "x"},
        {**at("00:00:01.000"), "canonical_id": "tied"},
        {**at("00:00:05.000"), "browser": "new", "page_url": "/b"},
        {**at("00:00:05.000"), "browser": "", "page_url": "/a"},
    ]
    s = sessions.windows(events(spark, rows)).first()
    assert (s["canonical_id"], s["browser"], s["pages"], s["event_types"]) == ("first", "new", ["/a", "/b"], {"click": 5})


def test_transition_counts(spark):
    rows = [{**at(f"00:00:0{k}.000"), "session_id": s} for k, s in enumerate(["A", "A", "B", "A", None, "", "A"])]
    r = sessions.start_counts(events(spark, rows), F.lit("2024-01-01").cast("date")).first()
    assert (r["total_sessions"], r["sessions_1d"]) == (3, 3)


def test_average_is_of_summed_milliseconds(spark):
    df = spark.createDataFrame([("t", "c", 1500), ("t", "c", 1500), ("t", "c", 3999)], "tenant_id string, canonical_id string, duration_ms bigint")
    r = sessions.closed_metrics(df).first()
    assert (r["completed_sessions"], r["avg_duration_sec"]) == (3, 2)


def test_calendar_date_is_that_of_the_last_arrival(spark):
    rows = [{"event_ts": "2024-02-01 00:00:00.000"}, {"event_ts": "2024-01-31 23:59:59.000"}]
    p = profiles.snapshot(events(spark, rows)).first()
    assert (p["total_events"], p["events_1d"], p["events_7d"]) == (2, 1, 1)


def test_top_items_ties_are_lexical_and_average_is_null_without_closed_sessions(spark):
    rows = [{**at(f"00:00:0{k}.000"), "page_url": p} for k, p in enumerate(["/b", "/a", "/c", "/c", ""])]
    for union in (True, False):
        p = profiles.snapshot(events(spark, rows), union).first()
        assert p["top_pages"] == ["/c", "/a", "/b"] and p["top_features"] == [] and p["avg_session_duration_sec"] is None and p["last_page"] == "/c"


def test_zero_length_closed_session_averages_zero(spark):
    rows = [at("00:00:00.000"), {**at("02:00:00.000"), "session_id": "other"}]
    assert profiles.snapshot(events(spark, rows)).first()["avg_session_duration_sec"] == 0.0


def test_changed_fields_and_actions(spark):
    of = lambda rows: profiles.with_sessions(profiles.snapshot(rows), rows)
    old = of(events(spark, [at("00:00:00.000")]))
    new = of(events(spark, [at("00:00:00.000"), {**at("00:00:01.000"), "browser": "x"}, {**at("00:00:01.000"), "canonical_id": "d"}]))
    got = {r["canonical_id"]: (r["action"], r["changed_fields"]) for r in profiles.changed_fields(new, old).collect()}
    assert got["c"] == ("update", ["total_events", "last_seen", "clicks", "last_browser"])
    assert got["d"] == ("create", list(profiles.ON_CREATE))
    assert {r["canonical_id"]: r["action"] for r in profiles.with_action(new, old).collect()} == {"c": "update", "d": "create"}


def test_nothing_comes_of_nothing(spark):
    none = events(spark, []).limit(0)
    assert sessions.windows(none).count() == 0 and profiles.snapshot(none).count() == 0 and admission.admit(none).count() == 0
