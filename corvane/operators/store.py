"""The store: ingestion columns, deduplicated and upserted tables, retention, rollups with sketches, and the lake's layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.columns import event_date, event_hour, or_empty
from corvane.operators.admission import dedup
from corvane.operators.profiles import KEY

EVENT_COLUMNS = ["event_id", "event_type", "tenant_id", "event_time", "anonymous_id", "user_id", "session_id", "page_url", "referrer", "element_id", "feature_name", "device_type", "browser", "os", "country", "properties", "canonical_id"]
#: Grain of the two cubes.
EVENT_DIMS = ["tenant_id", "event_date", "event_hour", "country", "event_type", "device_type", "browser", "page_url"]
SESSION_DIMS = ["tenant_id", "session_date", "session_hour", "country", "device_type", "browser"]
HLL_LOG2M = 8
RETENTION_DAYS, DEDUP_DAYS = 90, 3
#: Rows of a file.
FILE_ROWS = 1_000_000


def ingest_events(unified: DataFrame) -> DataFrame:
    """The stored event: 17 columns, event_date, event_hour, event_count, and what orders it."""
    return unified.withColumns({"event_date": event_date("event_ts"), "event_hour": event_hour("event_ts"), "event_count": F.lit(1)})


def ingest_sessions(sessions: DataFrame) -> DataFrame:
    """The stored session: no pages and no event types; session_date and session_hour from the start."""
    return sessions.select(
        "tenant_id", "session_id", "canonical_id", "start_ts", "end_ts", F.expr("duration_ms div 1000").alias("duration_sec"), "event_count", "device_type", "browser", "country",
        event_date("start_ts").alias("session_date"), event_hour("start_ts").alias("session_hour"),
    )


def retain(rows: DataFrame, now: str, time: str = "event_ts", days: int = RETENTION_DAYS) -> DataFrame:
    return rows.where(F.col(time) >= F.date_sub(F.lit(now).cast("timestamp_ntz"), days).cast("timestamp_ntz"))


def upsert(rows: DataFrame, version: str, keys: list[str] = KEY) -> DataFrame:
    """The row of the largest ``version`` of each key: full replacement, read-time form."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r"))
    return best.select(*keys, "_r.*").select(*rows.columns)


def merge_returning(old: DataFrame, new: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Keys, action, old and new (structs, null where absent) for a keyed MERGE of ``new`` into ``old``."""
    pack = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    return pack(new, "new").join(pack(old, "old"), keys, "left").select(*keys, F.when(F.col("old").isNull(), "insert").otherwise("update").alias("action"), "old", "new")


def cdc(old: DataFrame, new: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """keys, op (c, u, d), before, after: what turns one snapshot into the next; unchanged keys tell nothing."""
    pack = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    both = pack(old, "before").join(pack(new, "after"), keys, "full").where(~F.col("before").eqNullSafe(F.col("after")))
    op = F.when(F.col("before").isNull(), "c").when(F.col("after").isNull(), "d").otherwise("u")
    return both.select(*keys, op.alias("op"), "before", "after")


def debezium(changes: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The rows of cdc() as change messages: the keys, and value, JSON of before, after (with the keys; null if absent) and op."""
    whole = lambda side: F.when(F.col(side).isNotNull(), F.struct(*keys, f"{side}.*")).alias(side)
    return changes.select(*keys, F.to_json(F.struct(whole("before"), whole("after"), "op"), {"ignoreNullFields": "false"}).alias("value"))


def events_rollup(events: DataFrame) -> DataFrame:
    """The event cube: counts and mergeable sketches of distinct sessions and persons at full grain."""
    return events.groupBy(*EVENT_DIMS).agg(
        F.count("*").alias("events"), F.sum("event_count").alias("event_count"),
        F.hll_sketch_agg(F.col("session_id"), F.lit(HLL_LOG2M)).alias("sessions_hll"), F.hll_sketch_agg(F.col("canonical_id"), F.lit(HLL_LOG2M)).alias("users_hll"),
    )


def sessions_rollup(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(*SESSION_DIMS).agg(F.count("*").alias("sessions"), F.sum("duration_sec").alias("duration_sec"), F.sum("event_count").alias("event_count"))


def routed_count(events: DataFrame, cube: DataFrame | None, dims: list[str], where: dict[str, str] | None = None, grain: list[str] | None = None) -> tuple[DataFrame, str]:
    """Counts by ``dims`` under equality filters, and the path taken: from the cube if it has every column named.

    Catalyst has no rewrite to materialised rollups, so the choice is made here.
    """
    where, grain = where or {}, grain or EVENT_DIMS
    use = cube is not None and {*dims, *where} <= {*grain}
    rows = cube if use else events
    for c, v in where.items():
        rows = rows.where(F.col(c) == v)
    total = F.sum("events") if use else F.count("*")
    return rows.groupBy(*dims).agg(total.cast("long").alias("count")), "STAR_TREE" if use else "FULL_SCAN"


def users_from_cube(cube: DataFrame, dims: list[str]) -> DataFrame:
    """Approximate distinct persons by ``dims``: sketches are merged, never counts added."""
    return cube.groupBy(*dims).agg(F.hll_sketch_estimate(F.hll_union_agg("users_hll")).alias("users"))


def spread(rows: DataFrame, keys: list[str], day) -> DataFrame:
    """``rows`` dealt by ``keys`` and day, with adaptive execution splitting what is large and joining what is small by the
    sizes it has measured: a hot tenant or day is many tasks, and nothing is counted beforehand."""
    return rows.withColumn("_day", day).hint("rebalance", *map(F.col, [*keys, "_day"])).drop("_day")


def write_lake(unified: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by tenant, sorted by time inside files, with bloom filters on the two ids that are looked up."""
    rows = spread(unified.select(*EVENT_COLUMNS), ["tenant_id"], F.substring("event_time", 1, 10)).sortWithinPartitions("event_time")
    (
        rows.write.mode(mode).partitionBy("tenant_id")
        .option("parquet.bloom.filter.enabled#canonical_id", "true").option("parquet.bloom.filter.enabled#event_id", "true").option("maxRecordsPerFile", FILE_ROWS)
        .parquet(path)
    )


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*EVENT_COLUMNS)


def display(rows: DataFrame, columns: tuple[str, ...] = ("user_id", "session_id", "page_url", "device_type", "browser", "country")) -> DataFrame:
    """Optional text as the API shows it: null is ''."""
    return rows.withColumns({c: or_empty(c) for c in columns if c in rows.columns})


def dedup_events(events: DataFrame) -> DataFrame:
    return dedup(events, ("tenant_id", "event_id"))
