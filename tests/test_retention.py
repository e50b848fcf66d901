"""The registered retention query against its rule in Python, over every event."""

from __future__ import annotations

from datetime import datetime

import __spark_entry__ as entry
from corvane.plans import registry


def test_retention_takes_the_whole_table(spark, sf):
    rows = registry.raw_events(spark, sf).select("seq", "event_id", "tenant_id", "event_ts").collect()
    kept = [r for r in rows if r["event_ts"].replace(tzinfo=None) >= datetime(2024, 1, 15)]
    assert {r["seq"] % 2 for r in kept} == {0, 1}
    got = entry.queries()["retention"](spark, sf).collect()
    assert sorted((r["event_id"], r["tenant_id"]) for r in got) == sorted((r["event_id"], r["tenant_id"]) for r in kept)
