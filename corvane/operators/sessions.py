"""Sessions: 30-minute event-time windows of a tenant's session id, their summaries and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.columns import epoch_ms, last_value, present, text_ms
from corvane.functions.schemas import WINDOWS_DAYS, EventType

GAP, LATENESS_MS = "30 minutes", 5000
TYPES = tuple(sorted(t.value for t in EventType))


def windows(events: DataFrame, gap: str = GAP) -> DataFrame:
    """One row a closed or open session: times, counts and attributes, before formatting.

    Events without a session id take no part. Identity and start are those of the earliest event, attributes the latest
    present ones, ties by arrival: the first for the earliest, the last for the latest.
    """
    rows = events.where(present("session_id"))
    found = rows.groupBy("tenant_id", "session_id", F.session_window("event_ts", gap).alias("w")).agg(
        F.min_by("canonical_id", F.struct("event_ts", "seq")).alias("canonical_id"),
        F.min("event_ts").alias("start_ts"),
        F.max("event_ts").alias("end_ts"),
        F.count("*").alias("event_count"),
        F.array_sort(F.collect_set(F.when(present("page_url"), F.col("page_url")))).alias("pages"),
        *(F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in TYPES),
        F.collect_list(F.when(~F.col("event_type").isin(*TYPES), F.col("event_type"))).alias("others"),
        last_value("device_type", "event_ts", "seq").alias("device_type"),
        last_value("browser", "event_ts", "seq").alias("browser"),
        last_value("country", "event_ts", "seq").alias("country"),
    )
    # The types of the domain are counted as they come; only others, which sources should not send, are listed.
    known = F.array(*(F.struct(F.lit(t).alias("key"), F.col(f"n_{t}").cast("int").alias("value")) for t in TYPES))
    other = F.transform(F.array_distinct("others"), lambda t: F.struct(t.alias("key"), F.size(F.filter("others", lambda x: x == t)).alias("value")))
    counted = F.array_sort(F.concat(F.filter(known, lambda x: x["value"] > 0), other))
    return found.select(
        "tenant_id", "session_id", "canonical_id", "start_ts", "end_ts", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_count", "pages",
        F.map_from_entries(counted).alias("event_types"), "device_type", "browser", "country", (epoch_ms("end_ts") - epoch_ms("start_ts")).alias("duration_ms"),
    )


def closed(sessions: DataFrame, watermark) -> DataFrame:
    """Sessions whose window ends no later than ``watermark`` (a column or literal time)."""
    return sessions.where(F.col("window_end") <= watermark)


def watermark_of(events: DataFrame, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """A single row: the latest event time less the lateness."""
    return events.agg((F.max("event_ts") - F.expr(f"INTERVAL '{lateness_ms / 1000:.3f}' SECOND")).alias("watermark"))


def closed_by_stream(events: DataFrame, gap: str = GAP) -> DataFrame:
    """The sessions that the whole of ``events`` closes."""
    mark = watermark_of(events).withColumnRenamed("watermark", "_mark")
    return windows(events, gap).crossJoin(F.broadcast(mark)).where(F.col("window_end") <= F.col("_mark")).drop("_mark")  # one row


def summaries(sessions: DataFrame) -> DataFrame:
    """The 12 published columns."""
    return sessions.select(
        "session_id", "canonical_id", "tenant_id", text_ms("start_ts").alias("start_time"), text_ms("end_ts").alias("end_time"), F.expr("duration_ms div 1000").alias("duration_sec"),
        F.col("event_count").cast("int").alias("event_count"), "pages", F.col("event_types").cast("map<string,int>").alias("event_types"), "device_type", "browser", "country",
    )


def event_type_counts(sessions: DataFrame) -> DataFrame:
    """A row a session and event type."""
    return sessions.select("tenant_id", "session_id", text_ms("start_ts").alias("start_time"), F.explode("event_types").alias("event_type", "n"))


def event_types_json(sessions: DataFrame) -> DataFrame:
    """The counts as a JSON object with sorted keys, and the same put together from fragments."""
    fragments = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("event_types"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"].cast("string"))), ","), F.lit("}"))
    return sessions.select("tenant_id", "session_id", text_ms("start_ts").alias("start_time"), F.to_json("event_types").alias("event_types"), fragments.alias("fragments"))


def closed_metrics(sessions: DataFrame) -> DataFrame:
    """Completed sessions of a person: count, whole-second average of the milliseconds' sum, and the exact average."""
    return sessions.groupBy("tenant_id", "canonical_id").agg(
        F.count("*").alias("completed_sessions"),
        F.expr("sum(duration_ms) div count(*) div 1000").alias("avg_duration_sec"),
        (F.sum("duration_ms") / F.count("*") / F.lit(1000.0)).alias("avg_session_duration_sec"),
    )


def closed_calendar(sessions: DataFrame, today) -> DataFrame:
    """Completed sessions that began in the last 1, 7, 30, 90 days up to ``today``, by person."""
    day = F.to_date("start_ts")
    counts = [F.count(F.when(day.between(F.date_sub(today, n - 1), today), 1)).alias(f"sessions_{n}d") for n in WINDOWS_DAYS]
    return sessions.groupBy("tenant_id", "canonical_id").agg(F.count("*").alias("total_sessions"), *counts)


def reset_closed(current: DataFrame, closed_rows: DataFrame) -> DataFrame:
    """A keyed MERGE of closures into the open sessions (tenant_id, canonical_id, session_id, start_ts): a row that a closed
    session of that key, id and start matches loses its session; the rest is left alone."""
    ended = closed_rows.select("tenant_id", "canonical_id", "session_id", "start_ts").distinct().withColumn("_ended", F.lit(True))
    keys = ["tenant_id", "canonical_id", "session_id", "start_ts"]
    left = lambda c: F.when(F.col("_ended").isNull(), F.col(c)).alias(c)
    return current.join(ended, keys, "left").select("tenant_id", "canonical_id", left("session_id"), left("start_ts"))


def start_counts(events: DataFrame, today) -> DataFrame:
    """Changes to another present session id along a person's arrivals (A,A,B,A,null,'',A is three), total and by day range."""
    w = W.partitionBy("tenant_id", "canonical_id").orderBy("seq")
    sid = F.when(present("session_id"), F.col("session_id"))
    last = F.last(sid, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = events.withColumn("begins", F.when(sid.isNotNull() & ~sid.eqNullSafe(last), 1).otherwise(0)).withColumn("day", F.to_date("event_ts"))
    ranges = [F.coalesce(F.sum(F.when(F.col("day").between(F.date_sub(today, n - 1), today), F.col("begins"))), F.lit(0)).alias(f"sessions_{n}d") for n in WINDOWS_DAYS]
    return marked.groupBy("tenant_id", "canonical_id").agg(F.sum("begins").alias("total_sessions"), *ranges)
