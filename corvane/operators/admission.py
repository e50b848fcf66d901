"""Admission: the five-second lateness gate and deduplication, before anything windowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LATENESS_MS = 5000
CHUNK = 100_000


def running_max(df: DataFrame, value: Column, order: str, into: str, chunk: int = CHUNK) -> DataFrame:
    """Adds the largest ``value`` of all rows before a row, in the order of the integer column ``order``.

    Rows are cut into chunks of ``order``; chunk maxima, one row each, are scanned in order and joined back, so no task
    orders the whole stream.
    """
    df = df.withColumn("_c", F.floor(F.col(order) / chunk))
    tops = df.groupBy("_c").agg(F.max(value).alias("_top"))
    ahead = W.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(F.col("_c").alias("_k"), F.max("_top").over(ahead).alias("_before"))
    inside = W.partitionBy("_c").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_in", F.max(value).over(inside))
    return df.join(tops, df["_c"] == tops["_k"]).withColumn(into, F.greatest("_in", "_before")).drop("_c", "_k", "_in", "_before")


def admit(events: DataFrame, order: str = "seq", ts: str = "event_ts", lateness_ms: int = LATENESS_MS, chunk: int = CHUNK) -> DataFrame:
    """Rows no more than ``lateness_ms`` behind the latest time that arrived before them; the first row always."""
    late = F.expr(f"INTERVAL '{lateness_ms / 1000:.3f}' SECOND")
    out = running_max(events, F.col(ts), order, "_seen", chunk)
    return out.where(F.col("_seen").isNull() | (F.col(ts) >= F.col("_seen") - late)).drop("_seen")


def dedup(events: DataFrame, keys: tuple[str, ...] = ("event_id",), order: str = "seq") -> DataFrame:
    """The first arrival of each key; pre-aggregated, so a hot key costs a task one row."""
    first = events.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in events.columns if c not in keys]), order).alias("_r"))
    return first.select(*keys, "_r.*").select(*events.columns)
