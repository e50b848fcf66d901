"""Strict decoding of published profiles: what isn't exactly a release profile goes to quarantine or stops the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.schemas import PROFILE_RELEASE

NAMES = sorted(f.name for f in PROFILE_RELEASE.fields)


def _valid(raw: Column, p: Column) -> Column:
    keys = F.array_sort(F.json_object_keys(raw))
    texts = [F.col(f"p.{f.name}").isNotNull() for f in PROFILE_RELEASE.fields if f.name != "avg_session_duration_sec"]
    held = F.lit(True)
    for t in texts:
        held = held & t
    average = F.col("p.avg_session_duration_sec")
    sound = average.isNull() | (~F.isnan(average) & (average >= 0) & (average < float("inf")))
    # An average that is there but no number would read as null: its text must be null or parse.
    told = F.get_json_object(raw, "$.avg_session_duration_sec")
    sound = sound & (told.isNull() | F.try_to_number(told, F.lit("S" + "9" * 18)).isNotNull() | told.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"))
    times = (F.col("p.first_seen") >= 0) & (F.col("p.last_seen") >= F.col("p.first_seen"))
    return keys.eqNullSafe(F.array(*map(F.lit, NAMES))) & held & (F.col("p.tenant_id") != "") & (F.col("p.canonical_id") != "") & F.col("p.action").isin("create", "update") & times & sound


def split(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Good profiles, and the lines that aren't: JSON text with exactly the 22 fields, ids not empty, a known action, sound
    times, an average that is null or finite and not negative. JSON null and absent values are tombstones and go silently."""
    raw = lines.where(F.col(column).isNotNull() & (F.trim(column) != "null"))
    read = raw.select(F.col(column).alias("raw"), F.from_json(column, PROFILE_RELEASE, {"mode": "PERMISSIVE"}).alias("p"))
    read = read.withColumn("ok", F.coalesce(_valid(F.col("raw"), F.col("p")), F.lit(False)))
    return read.where("ok").select("p.*"), read.where("NOT ok").select(F.col("raw").alias(column))


def strict(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same, failing on the first bad line."""
    raw = lines.where(F.col(column).isNotNull() & (F.trim(column) != "null"))
    read = raw.select(F.col(column).alias("raw"), F.from_json(column, PROFILE_RELEASE, {"mode": "PERMISSIVE"}).alias("p"))
    ok = F.coalesce(_valid(F.col("raw"), F.col("p")), F.lit(False))
    return read.where(ok | F.raise_error(F.concat(F.lit("not a profile: "), F.substring("raw", 1, 200))).cast("boolean")).select("p.*")
