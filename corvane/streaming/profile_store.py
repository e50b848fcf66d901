"""Profiles kept up to date by micro-batch in a folder: touched persons are recomputed, the rest is left alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import profiles as P
from corvane.operators import store
from corvane.operators.profiles import KEY

BUCKETS, COMPACT = 32, 64


class ProfileStore:
    """events/: what was admitted. updates/: profiles as of each batch. base/: all profiles, every ``compact`` batches.
    clock/: the date and the latest event time that are known after a batch, so that neither is asked of all events.

    All are by batch, and by bucket of the key but for the clock. A batch that Spark repeats reads what earlier batches
    wrote and overwrites its own folders, so the outcome is the same; an empty batch tells nothing. Only the buckets of
    touched persons are read; when the stream's date moves, every person is recomputed, so that quiet ones lose what left
    their ranges. Rows arrive by batch, then time, then id: that order is a struct, and no task numbers them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, compact: int = COMPACT) -> None:
        self.spark, self.path, self.buckets, self.compact = spark, path, buckets, compact

    def _folders(self, what: str) -> list[str]:
        """Names in a folder; none if it isn't there."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []

    def _batches(self, what: str, before: int | None = None) -> list[int]:
        """The batches that have a folder, in order."""
        found = sorted(int(f.partition("=")[2]) for f in self._folders(what) if f.startswith("batch="))
        return [b for b in found if before is None or b < before]

    def _complete(self, what: str, batch: int) -> bool:
        """Whether a batch's folder is written to its end and has rows."""
        names = self._folders(f"{what}/batch={batch}")
        return "_SUCCESS" in names and len(names) > 1

    def _read(self, what: str, batches: list[int]) -> DataFrame | None:
        if not batches:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{what}").parquet(*(f"{self.path}/{what}/batch={b}" for b in batches))

    def _write(self, rows: DataFrame, what: str, batch_id: int) -> None:
        rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{what}/batch={batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz")).withColumn("bucket", self._bucket())
        self._write(rows.withColumn("seq", F.struct(F.lit(batch_id).cast("long").alias("in_batch"), "event_ts", "event_id")), "events", batch_id)
        if self._complete("events", batch_id):
            self._update(batch_id)
        if (batch_id + 1) % self.compact == 0 and (every := self._current(batch_id + 1)) is not None:
            self._write(every, "base", batch_id)

    def _bucket(self):
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def _update(self, batch_id: int) -> None:
        mine = self._read("events", [batch_id])
        now, before = self._clock(mine, batch_id)
        every = self._read("events", [b for b in self._batches("events", batch_id + 1) if self._complete("events", b)])
        buckets = None
        if before is not None and before.first()["today"] == now.first()["today"]:
            touched = mine.select(*KEY, "bucket").distinct()
            buckets = [r[0] for r in touched.select("bucket").distinct().collect()]  # at most self.buckets
            every = every.where(F.col("bucket").isin(buckets)).join(touched.select(*KEY), KEY, "left_semi")
        snapshot = P.snapshot_at(every, now.select("today"), P.S.watermark_of(now.select(F.col("latest").alias("event_ts"))))
        old = self._current(batch_id, buckets)
        if old is not None:
            plain = [c for c in snapshot.columns if c not in KEY]
            known = old.select(*KEY, F.struct(*plain).alias("_old"))
            joined = snapshot.join(known, KEY, "left").where(F.col("_old").isNull() | ~F.col("_old").eqNullSafe(F.struct(*plain)))
            snapshot = joined.withColumn("action", F.when(F.col("_old").isNull(), "create").otherwise("update")).drop("_old")
        else:
            snapshot = P.with_action(snapshot, None)
        self._write(snapshot.withColumn("bucket", self._bucket()), "updates", batch_id)

    def _clock(self, mine: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame | None]:
        """today, latest (one row) after this batch, written, and as they were before it."""
        known = self._batches("clock", batch_id)
        before = self._read("clock", known[-1:])
        now = mine.agg(F.max_by(F.to_date("event_ts"), "seq").alias("today"), F.max("event_ts").alias("latest"))
        if before is not None:
            seen = before.select(F.col("latest").alias("seen"))
            now = now.crossJoin(F.broadcast(seen)).select("today", F.greatest("latest", "seen").alias("latest"))  # one row each
        now.write.mode("overwrite").parquet(f"{self.path}/clock/batch={batch_id}")
        return self._read("clock", [batch_id]), before

    def updates(self) -> DataFrame | None:
        """Every profile that was published, with its batch."""
        rows = self._updates(self._batches("updates"))
        return rows if rows is None else rows.drop("bucket")

    def _updates(self, batches: list[int]) -> DataFrame | None:
        return self._read("updates", [b for b in batches if self._complete("updates", b)])

    def current(self, before_batch: int | None = None) -> DataFrame | None:
        """The latest profile of every person, after all batches or those before ``before_batch``; None if there is none."""
        rows = self._current(before_batch)
        return rows if rows is None else rows.drop("bucket")

    def _current(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        bases = [b for b in self._batches("base", before) if self._complete("base", b)]
        since = bases[-1] if bases else -1
        parts = [self._read("base", bases[-1:]), self._updates([b for b in self._batches("updates", before) if b > since])]
        rows = None
        for part in parts:
            if part is not None:
                rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return None
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return store.upsert(rows, "batch").drop("batch")
