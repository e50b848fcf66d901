"""Sources: Kafka, JSON and Parquet, batch or stream, always with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions.columns import parse_event_time
from corvane.functions.schemas import RAW_EVENT


def kafka_options(servers: str, topic: str, earliest: bool = True, committed: bool = True, **more: str) -> dict[str, str]:
    """Options of a topic's value stream; a consumer group's committed offsets are the checkpoint's business in Spark."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest" if earliest else "latest"}
    return out | ({"kafka.isolation.level": "read_committed"} if committed else {}) | more


def kafka_stream(spark: SparkSession, options: dict[str, str], schema: StructType = RAW_EVENT) -> DataFrame:
    """Needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").options(**options).load()
    return parse_json(raw.select(F.col("value").cast("string").alias("value")), schema)


def parse_json(lines: DataFrame, schema: StructType = RAW_EVENT, column: str = "value") -> DataFrame:
    """JSON text to columns: unknown fields are ignored, missing ones null, lines that don't parse or lack a required field go."""
    nullable = StructType.fromJson({**schema.jsonValue(), "fields": [{**f, "nullable": True} for f in schema.jsonValue()["fields"]]})
    parsed = lines.select(F.from_json(column, nullable, {"mode": "PERMISSIVE"}).alias("r"))
    needed = [f.name for f in schema.fields if not f.nullable]
    parsed = parsed.where(F.col("r").isNotNull())
    for c in needed:
        parsed = parsed.where(F.col(f"r.{c}").isNotNull())
    return parsed.select("r.*")


def json_events(spark: SparkSession, path: str, schema: StructType = RAW_EVENT) -> DataFrame:
    return parse_json(spark.read.text(path), schema)


def json_stream(spark: SparkSession, path: str, schema: StructType = RAW_EVENT, files: int = 1) -> DataFrame:
    """A folder of JSON lines, ``files`` a batch."""
    return parse_json(spark.readStream.option("maxFilesPerTrigger", files).text(path), schema)


def parquet_events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def with_time(events: DataFrame, zoned: bool = False, reject: bool = True) -> DataFrame:
    """Adds event_ts from event_time. zoned: a TIMESTAMP for watermarks. reject: rows whose time doesn't parse go."""
    ts = parse_event_time("event_time")
    out = events.withColumn("event_ts", ts.cast("timestamp") if zoned else ts)
    return out.where(F.col("event_ts").isNotNull()) if reject else out
