"""Sinks, change messages, debounce, subscriptions and stored tables."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from corvane.functions import display as D
from corvane.operators import store
from corvane.operators.stored import Stored
from corvane.plans import registry, stats
from corvane.sinks import writers
from corvane.streaming import pipelines
from tests.test_streaming import at, collect, feed, source


def test_records_and_options(spark):
    df = spark.createDataFrame([("k", 1, None), (None, 2, "x")], "id string, n int, note string")
    said = [(r["key"], json.loads(r["value"])) for r in writers.records(df, "id").collect()]
    assert said == [("k", {"id": "k", "n": 1}), (None, {"n": 2, "note": "x"})]
    assert writers.records(df).columns == ["value"]
    once = writers.kafka_options("b:9092", "t", once=True)
    assert once["topic"] == "t" and once["kafka.acks"] == "all" and once["kafka.enable.idempotence"] == "true" and once["kafka.bootstrap.servers"] == "b:9092"
    assert "kafka.acks" not in writers.kafka_options("b", "t") and writers.kafka_options("b", "t", client="x")["client"] == "x"


def test_a_repeated_batch_is_read_once(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, n int")
    sent = writers.numbered(df, 7, "id").unionByName(writers.numbered(df.repartition(3), 7, "id"))
    assert sent.count() == 6
    assert sorted(r["key"] for r in writers.first_records(sent).collect()) == ["a", "a", "b"]
    assert writers.first_records(writers.numbered(df, 7).unionByName(writers.numbered(df, 8))).count() == 6


def test_json_and_once_streams(spark, tmp_path):
    path = feed(tmp_path / "in", [at("00:00:01.000"), at("00:00:02.000", page_url="/é")])
    rows = source(spark, path).drop("event_ts")
    q = writers.json_stream(rows, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    sent = str(tmp_path / "sent")
    q = writers.kafka_once(rows, {}, str(tmp_path / "ck2"), "event_id", lambda b: b.write.mode("append").parquet(sent)).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(sent)
    assert sorted(r["key"] for r in writers.first_records(got).collect()) == ["00000", "00001"]
    assert got.select(writers.record_id()).distinct().count() == 2


def test_change_messages(spark):
    keys = "tenant_id string, canonical_id string, n int"
    old, new = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 3)], keys), spark.createDataFrame([("t", "b", 5), ("t", "c", 3), ("t", "d", None)], keys)
    said = {r["canonical_id"]: json.loads(r["value"]) for r in store.debezium(store.cdc(old, new)).collect()}
    row = lambda c, n: {"tenant_id": "t", "canonical_id": c, "n": n}
    assert said == {"a": {"before": row("a", 1), "after": None, "op": "d"}, "b": {"before": row("b", 2), "after": row("b", 5), "op": "u"}, "d": {"before": None, "after": row("d", None), "op": "c"}}


def test_debounce_tells_the_last_of_a_burst(spark, tmp_path):
    where = tmp_path / "in"
    where.mkdir()
    said = [("a", 1, "create", "event", ["x"]), ("a", 2, "update", "event", ["n"]), ("a", 3, "update", "event", ["n", "page"]), ("b", 1, "create", "event", []), ("b", 2, "update", "session_timeout", ["avg"])]
    (where / "0.json").write_text("".join(json.dumps(dict(zip(("canonical_id", "n", "action", "trigger", "changed_fields"), r, strict=True))) + "\n" for r in said))
    rows = spark.readStream.schema("canonical_id string, n int, action string, trigger string, changed_fields array<string>").json(str(where))
    q = pipelines.debounced(rows, 10).writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for _ in range(80):
            if spark.table("debounced").count() >= 4:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    got = sorted((r["canonical_id"], r["n"], tuple(r["changed_fields"])) for r in spark.table("debounced").collect())
    assert got == [("a", 1, ("x",)), ("a", 3, ("n", "page")), ("b", 1, ()), ("b", 2, ("avg",))]


def test_an_idle_stream_holds_nothing_back_and_subscribers_are_served(spark, tmp_path):
    busy = source(spark, feed(tmp_path / "busy", [at("00:00:00.000"), at("02:00:00.000"), at("04:00:00.000")]))
    idle = source(spark, feed(tmp_path / "idle", [at("00:00:00.000", session_id="i")]))
    both = pipelines.idle_tolerant(spark, busy.withWatermark("event_ts", "5 seconds"), idle.withWatermark("event_ts", "5 seconds")).withColumn("canonical_id", F.lit("c"))
    got = collect(spark, pipelines.session_summaries(both), tmp_path, "idle")
    assert {r["session_id"] for r in got} == {"s", "i"}
    hub = pipelines.Broadcast()
    mine = hub.subscribe(lambda r: r["event_id"] == "00001")
    pipelines.serve(source(spark, str(tmp_path / "busy")), hub, str(tmp_path / "ck-serve")).trigger(availableNow=True).start().awaitTermination()
    assert [r["event_time"] for r in mine] == ["2024-01-01 02:00:00.000"]


def test_stored_tables_are_built_once_and_pruned(spark, sf):
    first, again = registry.stored(spark, sf), registry.stored(spark, sf)
    assert first.source == again.source and sorted(first.events().inputFiles()) == sorted(again.events().inputFiles())
    one = first.events().where("tenant_id = 'tenant-1' AND event_date >= '2024-01-20'")
    rows, told = stats.run(one)
    assert 0 < told.segments_read < told.segments_total and told.rows_scanned >= len(rows) > 0
    assert dict(first.events().dtypes)["event_date"] == "string"
    fresh = Stored(spark, f"{sf}/events.parquet", lambda: registry.raw_events(spark, sf), fresh=True)
    counts = fresh.build()
    assert counts["events"] == registry.raw_events(spark, sf).count() and counts["profiles"] > 0
    assert set(fresh.events().inputFiles()).isdisjoint(first.events().inputFiles())


def test_a_source_that_changes_is_read_again(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    before = Stored(spark, str(tmp_path / "x"), lambda: None).source
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "x"))
    assert Stored(spark, str(tmp_path / "x"), lambda: None).source != before


def test_hot_tenants_are_many_tasks(spark, tmp_path):
    rows = spark.range(200_000, numPartitions=8).select(F.sha2(F.col("id").cast("string"), 256).alias("event_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise("quiet").alias("tenant_id"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "1m")
    try:
        dealt = store.spread(rows, ["tenant_id"], F.lit("2024-01-01"))
        assert dealt.columns == rows.columns
        dealt.write.partitionBy("tenant_id").parquet(f"{tmp_path}/out")
    finally:
        spark.conf.unset(size)
    assert len(list((tmp_path / "out" / "tenant_id=hot").glob("*.parquet"))) > 3 and spark.read.parquet(f"{tmp_path}/out").count() == 200_000


@pytest.mark.parametrize(("text", "want"), [("2024-01-01T00:00:58Z", "just now"), ("2024-01-01 00:00:01.5", "58s ago"), ("2023-12-31 23:00:00", "1h ago"), ("2023-12-02 00:00:00", "30d ago"), ("2023-12-03 00:01:00.1", "28d ago"), ("2024-01-02 00:00:00", "just now"), ("soon", "soon"), (None, None)])
def test_relative_time(spark, text, want):
    now = F.lit("2024-01-01 00:01:00").cast("timestamp_ntz")
    got = spark.createDataFrame([(text,)], "t string").select(D.relative_time("t", now), D.absolute_time("t")).first()
    assert got[0] == ("2023-12-02" if want == "30d ago" else want)
    assert text != "2024-01-01T00:00:58Z" or got[1] == "2024-01-01 00:00:58 UTC"


def test_display(spark):
    r = spark.range(1).select(D.short_id(F.lit("123456789")), D.short_id(F.lit("12345678")), D.country_name(F.lit("de")), D.country_name(F.lit("zz")), D.country_flag(F.lit("gb")), D.icon(F.lit("Mobile")), D.icon(F.lit("fridge"))).first()
    assert tuple(r) == ("12345678...", "12345678", "Germany", "Unknown", "\U0001f1ec\U0001f1e7", "mobile", "monitor")
