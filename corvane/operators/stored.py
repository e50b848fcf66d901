"""The tables that the catalogue reads: built once from raw events, by tenant and date, and read by every query after that."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import identity, profiles, sessions, store
from corvane.operators.state import shared_folder

#: Path and schema of each table built in this process, by folder, source and name.
_BUILT: dict[tuple[str, str, str], tuple[str, object]] = {}


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of the files under ``path``, their sizes and times: another one if the source is written again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = [files.getFileStatus(place), *files.listStatus(place)]
    told = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in listed)
    return hashlib.sha256("\n".join([path, *told]).encode()).hexdigest()


class Stored:
    """events, sessions, profiles, event_cube and session_cube of a source of raw events.

    Each is written when it is first asked for, in the folder that driver and executors share, and reads the tables before
    it, not the source. Partitions are by tenant and date, so filters on those prune; a hot tenant or day is many files.
    """

    def __init__(self, spark: SparkSession, source: str, raw: Callable[[], DataFrame], fresh: bool = False) -> None:
        self.spark, self.raw, self.folder = spark, raw, shared_folder(spark)
        self.source = uuid.uuid4().hex if fresh else state_of(spark, source)

    def _table(self, name: str, make: Callable[[], DataFrame], keys: list[str], day: str | None) -> DataFrame:
        at = (self.folder, self.source, name)
        if at not in _BUILT:
            rows = make()
            path = f"{self.folder}/stored-{uuid.uuid4().hex}/{name}"
            dealt = store.spread(rows, keys, F.col(day) if day else F.lit(None).cast("string"))
            dealt.write.partitionBy(*keys, *([day] if day else [])).option("maxRecordsPerFile", store.FILE_ROWS).parquet(path)
            _BUILT[at] = path, rows.schema
        path, schema = _BUILT[at]
        # With the schema told, dates in folder names stay text.
        return self.spark.read.schema(schema).parquet(path).select(*schema.fieldNames())

    def events(self) -> DataFrame:
        """The 17 columns, what orders them, event_date, event_hour and event_count."""
        return self._table("events", lambda: store.ingest_events(identity.unified(identity.resolve(self.raw()))), ["tenant_id"], "event_date")

    def windows(self) -> DataFrame:
        """Sessions with pages and event types, open ones too."""
        return self._table("windows", lambda: sessions.windows(self.events()).withColumn("session_date", F.date_format("start_ts", "yyyy-MM-dd")), ["tenant_id"], "session_date").drop("session_date")

    def sessions(self) -> DataFrame:
        return store.ingest_sessions(self.windows())

    def profiles(self) -> DataFrame:
        return self._table("profiles", lambda: profiles.snapshot(self.events()), ["tenant_id"], None)

    def event_cube(self) -> DataFrame:
        return self._table("event_cube", lambda: store.events_rollup(self.events()), ["tenant_id"], "event_date")

    def session_cube(self) -> DataFrame:
        return self._table("session_cube", lambda: store.sessions_rollup(self.sessions()), ["tenant_id"], "session_date")

    def build(self) -> dict[str, int]:
        """Builds all that isn't there; rows of each.

        Everything reads the events, so they are first; what doesn't wait for another table is written at the same time,
        so that the last tasks of one table don't leave the cluster idle.
        """
        rows = {"events": self.events().count()}
        chains = ("windows", "session_cube"), ("profiles",), ("event_cube",)

        def run(names: tuple[str, ...]) -> dict[str, int]:
            return {name: getattr(self, name)().count() for name in names}

        with ThreadPoolExecutor(len(chains)) as pool:
            for built in pool.map(inheritable_thread_target(self.spark)(run), chains):
                rows |= built
        return rows
