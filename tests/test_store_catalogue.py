from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.functions import validate as V
from corvane.functions.columns import bucket_label, epoch_ms, from_epoch_ms, one_decimal, parse_event_time
from corvane.functions.schemas import PROFILE_FULL, PROFILE_RELEASE, RAW_EVENT, SESSION_SUMMARY, UNIFIED_EVENT, TimeRange
from corvane.operators import store
from corvane.plans import catalogue as C
from corvane.plans import registry, stats
from corvane.sources.generator import synthetic
from corvane.sources.readers import kafka_options
from corvane.streaming import pipelines


def test_schema_sizes():
    assert [len(s) for s in (RAW_EVENT, UNIFIED_EVENT, SESSION_SUMMARY, PROFILE_RELEASE, PROFILE_FULL)] == [16, 17, 12, 22, 33]


def test_arguments():
    assert V.users_limit(None) == 25 and V.users_limit(1000) == 200 and V.users_limit(0) == 1 and V.events_limit(None) == 100 and V.tenant_events_limit(None) == 50 and V.recent_limit(9999) == 200 and V.offset(-4) == 0
    assert V.identifier("tenant-1_a.b") and V.date_hint("2024-01-01") and V.date_hint("1' OR") is None
    for bad in ("", "a'b", "a b", "x;--"):
        with pytest.raises(ValueError):
            V.identifier(bad)
    for bad in ("2024", "2024-01-01 00:00:00'", "x" * 12):
        with pytest.raises(ValueError):
            V.timestamp_text(bad)
    with pytest.raises(ValueError):
        V.choice(C.Dimension, "properties")


def test_cutoffs():
    assert str(C.cutoff("2024-01-31 10:30:00", TimeRange.DAY)) == "2024-01-30 10:00:00"
    assert str(C.cutoff("2024-01-31 10:30:00", TimeRange.WEEK)) == "2024-01-24 00:00:00"


def test_labels_and_times(spark):
    cases = {"2024-01-05 07": "07:00", "2024-01-05": "Jan 05", "1704412800000": "Jan 05", "odd": "odd"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["l"] for r in df.select("t", bucket_label("t").alias("l")).collect()} == cases
    r = spark.range(1).select(one_decimal(F.lit(2.25)), one_decimal(F.lit(-2.25)), epoch_ms(from_epoch_ms(F.lit(1704412800123)))).first()
    assert tuple(r) == (2.3, -2.3, 1704412800123)
    got = [str(x[0]) for x in spark.createDataFrame([("2024-01-05 07:08:09.123",), ("2024-01-05 07:08:09.12",), ("no",)], "t string").select(parse_event_time("t").cast("string")).collect()]
    assert got == ["2024-01-05 07:08:09.123", "2024-01-05 07:08:09.12", "None"]


@pytest.fixture(scope="module")
def tables(spark, sf):
    return registry.tables(spark, sf)


def test_sketches_are_near_and_merge_to_one_pass(spark, tables):
    exact = {r["bucket"]: r["count"] for r in C.users_over_time(tables, TimeRange.MONTH, exact=True).collect()}
    near = {r["bucket"]: r["count"] for r in C.users_over_time(tables, TimeRange.MONTH).collect()}
    assert exact.keys() == near.keys() and all(abs(near[k] - exact[k]) <= max(2, 0.2 * exact[k]) for k in exact)
    cube = store.events_rollup(tables.events)
    merged = {r["tenant_id"]: r["users"] for r in store.users_from_cube(cube, ["tenant_id"]).collect()}
    once = {r["tenant_id"]: r["n"] for r in tables.events.groupBy("tenant_id").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col("canonical_id"), F.lit(8))).alias("n")).collect()}
    assert merged == once


def test_routing(tables):
    cube = store.events_rollup(tables.events)
    for dims, want in ((["country"], "STAR_TREE"), (["os"], "FULL_SCAN")):
        rows, path = store.routed_count(tables.events, cube, dims, {"tenant_id": "tenant-1"})
        assert path == want
        plain, _ = store.routed_count(tables.events, None, dims, {"tenant_id": "tenant-1"})
        assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert C.explain_path(["os", "country"], [], store.EVENT_DIMS) == "PARTIAL"


def test_compat_limit_cuts_the_newest_bucket(tables):
    full = C.sessions_over_time(tables, TimeRange.WEEK).collect()
    cut = C.sessions_over_time(tables, TimeRange.WEEK, compat_limit=True).collect()
    assert len(cut) == min(7, len(full)) and cut == full[: len(cut)]


def test_lake_prunes_and_keeps_null_apart_from_empty(spark, tables, tmp_path):
    path = str(tmp_path / "lake")
    store.write_lake(tables.events, path)
    back = store.read_lake(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, tables.events.select(*store.EVENT_COLUMNS).collect()), key=str)
    plan = back.where("tenant_id = 'tenant-1' AND event_time > '2024-01-05'").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "GreaterThan(event_time" in plan


def test_cdc_chain_replays(spark):
    old = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 3)], "tenant_id string, canonical_id string, n int")
    new = spark.createDataFrame([("t", "a", 1), ("t", "b", 5), ("t", "d", 4)], "tenant_id string, canonical_id string, n int")
    got = {r["canonical_id"]: (r["op"], r["before"] and r["before"]["n"], r["after"] and r["after"]["n"]) for r in store.cdc(old, new).collect()}
    assert got == {"b": ("u", 2, 5), "c": ("d", 3, None), "d": ("c", None, 4)}


def test_injection_is_refused(tables):
    for bad in ("x' OR '1'='1", "a; DROP TABLE"):
        with pytest.raises(ValueError):
            C.live_profile(tables, bad, "c")
    with pytest.raises(ValueError):
        C.events(tables, None, "page_view' --")


def test_stats_and_live_lists(spark, tables):
    rows, told = stats.run(C.tenants(tables), "STAR_TREE")
    assert told.rows == len(rows) and told.path == "STAR_TREE" and "Aggregate" in told.sql
    shown = tables.profiles.orderBy("first_seen").limit(30)
    out = pipelines.merged_list(shown, shown.limit(1).withColumn("first_seen", F.lit(9_999_999_999_999)))
    assert out.count() == 25 and out.first()["first_seen"] == 9_999_999_999_999
    queue = pipelines.Broadcast(3)
    mine, other = queue.subscribe(), queue.subscribe(lambda r: False)
    queue(tables.events.limit(5), 0)
    assert len(mine) == 3 and not other


def test_generator_is_repeatable_and_resolves(spark):
    a, b = synthetic(spark, 600), synthetic(spark, 600, partitions=7)
    assert a.columns == RAW_EVENT.fieldNames() and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_kafka_options():
    assert kafka_options("h:1", "raw-events") == {"kafka.bootstrap.servers": "h:1", "subscribe": "raw-events", "startingOffsets": "earliest", "kafka.isolation.level": "read_committed"}
