"""Streams: admission, identity, sessions, profiles and what is published, each with a batch twin."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corvane.functions.columns import present
from corvane.operators import sessions as S

LATENESS = "5 seconds"


def admitted(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Drops rows behind the watermark, and repeated events, before any window sees them.

    A session aggregation alone would keep a late row as long as its window is open; this stage drops it by its own time.
    The watermark moves by micro-batch, so a row is late only against earlier batches. event_ts must be a TIMESTAMP.
    """
    return events.withWatermark("event_ts", lateness).dropDuplicatesWithinWatermark(["tenant_id", "event_id"])


def deduplicated(events: DataFrame, horizon: str = "3 days") -> DataFrame:
    """The store's ingestion: one row an event id within the horizon."""
    return events.withWatermark("event_ts", horizon).dropDuplicatesWithinWatermark(["tenant_id", "event_id"])


def _with(schema: StructType, *more: str) -> StructType:
    return StructType([*schema.fields, *(StructField(c, StringType()) for c in more)])


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r["event_ts"], r["event_id"]))


class RowGate(StatefulProcessor):
    """Row by row: passes what is no more than ``lateness_ms`` behind the latest time seen before. One key owns a stream's clock."""

    def __init__(self, lateness_ms: int = 5000) -> None:
        self.lateness_ms = lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        latest = self.latest.get()[0] if self.latest.exists() else None
        for r in sorted(rows, key=lambda r: r["seq"]):
            ms = int(r["event_ts"].timestamp() * 1000)
            if latest is None or ms >= latest - self.lateness_ms:
                yield r
            latest = ms if latest is None else max(latest, ms)
        if latest is not None:
            self.latest.update((latest,))

    def close(self) -> None:
        pass


def exact_gate(events: DataFrame, lateness_ms: int = 5000) -> DataFrame:
    """The gate by row instead of by batch; all rows pass one task, so it is for modest streams. Needs seq, the arrival order."""
    keyed = events.withColumn("clock", F.lit(0))
    return keyed.groupBy("clock").transformWithState(RowGate(lateness_ms), keyed.schema, "Append", "None").drop("clock")


def idle_tolerant(spark: SparkSession, *streams: DataFrame) -> DataFrame:
    """Streams as one, none of which holds back the watermark by being idle.

    Spark's watermark is that of all rows of a stream, so an idle partition never holds it back; of several streams the
    slowest would, unless the session's policy is the largest. Rows of a stream that wakes up behind it are late.
    """
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


class Debounce(StatefulProcessor):
    """Updates of a key: the first and those by timers pass at once, those by events are held until ``delay_ms`` after the
    first of them, and then the last is told, with all the fields that changed meanwhile."""

    def __init__(self, delay_ms: int = 5000) -> None:
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("json", StringType())]))

    def _tell(self, said: dict) -> Row:
        return Row(*said)(*said.values())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = json.loads(self.held.get()[0]) if self.held.exists() else None
        for r in rows:
            said = r.asDict(recursive=True)
            if said["action"] == "create" or said["trigger"] != "event":
                # What was held is older than this, and this says all of it.
                if held:
                    said["changed_fields"] = [*held["changed_fields"], *(c for c in said["changed_fields"] if c not in held["changed_fields"])]
                    held = None
                    for t in list(self.handle.listTimers()):
                        self.handle.deleteTimer(t)
                yield self._tell(said)
            else:
                if held:
                    said["changed_fields"] = [*held["changed_fields"], *(c for c in said["changed_fields"] if c not in held["changed_fields"])]
                else:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay_ms)
                held = said
        if held:
            self.held.update((json.dumps(held),))
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            held = json.loads(self.held.get()[0])
            self.held.clear()
            yield self._tell(held)

    def close(self) -> None:
        pass


def debounced(updates: DataFrame, delay_ms: int = 5000) -> DataFrame:
    """Profile updates (a stream with canonical_id, action, trigger and changed_fields) with one for each key and delay."""
    return updates.groupBy("canonical_id").transformWithState(Debounce(delay_ms), updates.schema, "Append", "ProcessingTime")


def serve(updates: DataFrame, receivers: Broadcast, checkpoint: str) -> DataStreamWriter:
    """A stream whose rows go to whoever has subscribed to ``receivers``: the consumer behind subscriptions."""
    return updates.writeStream.foreachBatch(receivers).option("checkpointLocation", checkpoint)


class Identity(StatefulProcessor):
    """The identity rule over a tenant's two maps; rows of a batch in the order of time, then id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        key, value = StructType([StructField("k", StringType())]), StructType([StructField("v", StringType())])
        self.devices = handle.getMapState("devices", key, value)
        self.users = handle.getMapState("users", key, value)

    def _get(self, state, key: str):
        return state.getValue((key,))[0] if state.containsKey((key,)) else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        from hashlib import sha256

        for r in _in_order(rows):
            device, user = r["anonymous_id"], r["user_id"] or None
            mine = self._get(self.devices, device)
            theirs = self._get(self.users, user) if user else None
            merge = mine if mine and theirs and mine != theirs else None
            canon = theirs or mine or sha256(f"{r['tenant_id']}|{r['event_id']}".encode()).hexdigest()[:32]
            if mine != canon:
                self.devices.updateValue((device,), (canon,))
            if user and theirs is None:
                self.users.updateValue((user,), (canon,))
            yield Row(**r.asDict(), canonical_id=canon, merge_old=merge)

    def close(self) -> None:
        pass


def resolve(events: DataFrame) -> DataFrame:
    """The capture stream: every event with canonical_id, and merge_old where a merge is told. Parallel by tenant."""
    return events.groupBy("tenant_id").transformWithState(Identity(), _with(events.schema, "canonical_id", "merge_old"), "Append", "None")


def session_summaries(unified: DataFrame, gap: str = S.GAP) -> DataFrame:
    """Closed sessions, append mode; ``unified`` is admitted, so its watermark is set. One stateful aggregation."""
    rows = unified if "seq" in unified.columns else unified.withColumn("seq", F.col("event_id"))
    return S.summaries(S.windows(rows, gap))


def fan_out(batch: DataFrame, outputs: dict[str, Callable[[DataFrame], DataFrame]], path: str, batch_id: int) -> None:
    """A captured batch to several projections, each in a folder of its own that a repeated batch overwrites."""
    held = batch.persist()
    try:
        for name, project in outputs.items():
            project(held).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
    finally:
        held.unpersist()


def latest_per_key(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Coalescing before fan-out: the last update of each key in a batch."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*batch.columns)


def sampled(batch: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` events of a flush; the rest is for the store, not for the live view."""
    return batch.orderBy("event_ts", "event_id").limit(n)


def subscribe_profiles(profiles: DataFrame, tenant_id: str | None = None, canonical_id: str | None = None) -> DataFrame:
    out = profiles if tenant_id is None else profiles.where(F.col("tenant_id") == tenant_id)
    return out if canonical_id is None else out.where(F.col("canonical_id") == canonical_id)


def subscribe_events(events: DataFrame, tenant_id: str) -> DataFrame:
    return events.where(F.col("tenant_id") == tenant_id)


def signed_in(events: DataFrame) -> DataFrame:
    return events.where(present("user_id"))


def merged_list(shown: DataFrame, updates: DataFrame, keep: int = 25) -> DataFrame:
    """A live list of profiles after updates: newest first_seen first, ties by key, ``keep`` rows. Both have the same columns."""
    keys = ["tenant_id", "canonical_id"]
    both = shown.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, "_new").drop("_new").orderBy(F.desc("first_seen"), *keys).limit(keep)


def newest(shown: DataFrame, events: DataFrame, keep: int = 200) -> DataFrame:
    """The live ring of events: the newest ``keep``."""
    return shown.unionByName(events).orderBy(F.desc("event_ts"), F.desc("event_id")).limit(keep)


class Broadcast:
    """Fan-out of micro-batches to receivers in the driver; a receiver that lags behind ``capacity`` rows loses the oldest."""

    def __init__(self, capacity: int = 1024) -> None:
        self.capacity, self.receivers = capacity, []

    def subscribe(self, wanted: Callable[[Row], bool] = lambda r: True):
        from collections import deque

        queue = deque(maxlen=self.capacity)
        self.receivers.append((wanted, queue))
        return queue

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if not self.receivers:
            return  # nobody listens, nothing is computed
        # Every row is offered to everyone, a partition at a time in the driver; only a receiver's own queue drops rows.
        for r in batch.toLocalIterator():
            for wanted, queue in self.receivers:
                if wanted(r):
                    queue.append(r)
