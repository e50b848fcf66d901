from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from corvane.functions.schemas import PROFILE_RELEASE, RAW_EVENT
from corvane.operators import identity, profiles
from corvane.sources import readers
from corvane.streaming import decode, pipelines
from corvane.streaming.profile_store import ProfileStore

BASE = {"event_type": "click", "tenant_id": "t", "anonymous_id": "a", "session_id": "s"}


def feed(path, rows, per_file=1):
    """JSON lines in files whose times are apart, as the file source reads them in that order."""
    path.mkdir(parents=True, exist_ok=True)
    for k in range(0, len(rows), per_file):
        f = path / f"{k:05d}.json"
        f.write_text("".join(json.dumps({**BASE, "event_id": f"{k + i:05d}", **r}) + "\n" for i, r in enumerate(rows[k : k + per_file])))
        os.utime(f, (time.time() - 1000 + k, time.time() - 1000 + k))
    return str(path)


def source(spark, path):
    return readers.with_time(readers.json_stream(spark, path), zoned=True)


def collect(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def at(t, **more):
    return {"event_time": f"2024-01-01 {t}", **more}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_gate_then_session_gives_the_cutoff_answer(spark, tmp_path):
    rows = [at("00:00:10.000"), at("00:00:05.000"), at("00:00:04.999"), at("00:00:12.000"), at("02:00:00.000", session_id="", event_id="x")]
    events = pipelines.admitted(source(spark, feed(tmp_path / "in", rows)))
    got = collect(spark, pipelines.session_summaries(events.withColumn("canonical_id", F.lit("c"))), tmp_path, "cutoff")
    assert [(r["start_time"][-12:], r["end_time"][-12:], r["event_count"]) for r in got] == [("00:00:05.000", "00:00:12.000", 3)]


def test_row_gate_is_exact_within_a_batch(spark, tmp_path):
    rows = [at("00:00:10.000"), at("00:00:05.000"), at("00:00:04.999"), at("00:00:12.000")]
    events = source(spark, feed(tmp_path / "in", rows, per_file=4)).withColumn("seq", F.col("event_id").cast("long"))
    got = collect(spark, pipelines.exact_gate(events), tmp_path, "rowgate")
    assert sorted(r["event_id"] for r in got) == ["00000", "00001", "00003"]


def people():
    who = [("device-a", None), ("device-a", ""), ("device-a", "alice"), ("device-b", None), ("device-b", "alice"), ("device-b", None), ("device-c", "alice"), ("device-d", "bob"), ("device-a", "bob")]
    return [at(f"00:00:{k:02d}.000", anonymous_id=a, user_id=u) for k, (a, u) in enumerate(who)]


def test_identity_stream_equals_batch_across_a_restart(spark, tmp_path):
    rows = people()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for part in (rows[:5], rows):
        path = feed(tmp_path / "in", part)
        q = pipelines.resolve(source(spark, path)).writeStream.format("parquet").option("checkpointLocation", ck).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["event_id"]: (r["canonical_id"], r["merge_old"]) for r in spark.read.parquet(out).collect()}
    batch = readers.with_time(readers.json_events(spark, str(tmp_path / "in"))).withColumn("seq", F.col("event_id").cast("long"))
    want = {r["event_id"]: (r["canonical_id"], r["merge_old"]) for r in identity.resolve(batch).collect()}
    assert got == want and len(got) == len(rows) and sum(1 for _, m in got.values() if m) == 2


@pytest.mark.parametrize("compact", [64, 1])
def test_profile_store_equals_batch_and_refreshes_quiet_keys(spark, tmp_path, compact):
    rows = [
        at("10:00:00.000", page_url="/a"), at("10:00:05.000", page_url="/b", session_id="s"), at("11:00:00.000", anonymous_id="b", session_id="z"),
        {"event_time": "2024-01-02 00:00:01.000", "anonymous_id": "b", "session_id": "z"},
    ]
    keeper = ProfileStore(spark, str(tmp_path / "store"), buckets=4, compact=compact)
    stream = pipelines.admitted(source(spark, feed(tmp_path / "in", rows))).withColumn("canonical_id", F.col("anonymous_id"))
    q = stream.writeStream.foreachBatch(keeper).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    events = readers.with_time(readers.json_events(spark, str(tmp_path / "in"))).withColumn("seq", F.col("event_id").cast("long")).withColumn("canonical_id", F.col("anonymous_id"))
    order = sorted(profiles.PROFILE_RELEASE.fieldNames())[1:]
    pick = lambda df: sorted(tuple(str(r[c]) for c in order) for r in df.collect())
    assert pick(keeper.current().drop("action")) == pick(profiles.snapshot(events))
    now = {r["canonical_id"]: r for r in keeper.current().collect()}
    assert now["a"]["events_1d"] == 0 and now["a"]["avg_session_duration_sec"] == 5.0 and now["b"]["events_1d"] == 1
    told = [(r["batch"], r["canonical_id"], r["action"]) for r in keeper.updates().orderBy("batch", "canonical_id").collect()]
    assert told[0][1:] == ("a", "create") and told[1][1:] == ("a", "update") and ("b", "create") in [t[1:] for t in told]
    # A batch that is repeated, and one without rows, change nothing.
    last = max(t[0] for t in told)
    held, empty = pick(keeper.current()), events.drop("seq").limit(0)
    again = spark.read.option("basePath", str(tmp_path / "store/events")).parquet(str(tmp_path / f"store/events/batch={last}")).drop("seq", "bucket", "batch")
    keeper(spark.createDataFrame(again.collect(), again.schema), last)
    assert pick(keeper.current()) == held and keeper.updates().count() == len(told)
    keeper(empty, last + 1)
    assert pick(keeper.current()) == held and keeper.updates().count() == len(told)


def profile(**over):
    p = {f.name: ([] if f.name.startswith("top_") else 1 if f.dataType.typeName() == "long" else None if f.dataType.typeName() == "double" else "x") for f in PROFILE_RELEASE.fields}
    return {**p, "action": "create", **over}


def test_strict_decode(spark):
    good = [profile(), profile(avg_session_duration_sec=0.0, user_id="")]
    bad = [{**profile(), "extra": 1}, {k: v for k, v in profile().items() if k != "user_id"}, profile(tenant_id=""), profile(action="delete"), profile(first_seen=-1), profile(avg_session_duration_sec=-1.0), profile(avg_session_duration_sec="much"), profile(first_seen="soon")]
    lines = [json.dumps(x) for x in (*good, *bad)] + ["null", None, "{broken"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    ok, quarantine = decode.split(df)
    assert ok.count() == len(good) and quarantine.count() == len(bad) + 1
    with pytest.raises(Exception, match="not a profile"):
        decode.strict(df).collect()


def test_coalescing_and_sampling(spark):
    df = spark.createDataFrame([("t", "c", k, k) for k in range(9)] + [("t", "d", 1, 1)], "tenant_id string, canonical_id string, event_ts int, event_id int")
    assert sorted(r["event_id"] for r in pipelines.latest_per_key(df, ["tenant_id", "canonical_id"], "event_id").collect()) == [1, 8]
    assert pipelines.sampled(df).count() == 5
    assert pipelines.subscribe_profiles(df, "t", "d").count() == 1


def test_json_source_keeps_null_and_empty_apart_and_drops_what_lacks_a_field(spark, tmp_path):
    rows = [at("00:00:00.000", user_id=""), at("00:00:00.000", user_id=None, unknown=1), at("00:00:00.000", tenant_id=None)]
    path = feed(tmp_path / "in", rows)
    (tmp_path / "in" / "zz.json").write_text("{not json\n")
    got = readers.json_events(spark, path)
    assert got.columns == RAW_EVENT.fieldNames() and sorted(str(r["user_id"]) for r in got.collect()) == ["", "None"]
