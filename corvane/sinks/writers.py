"""Sinks: Kafka (plain, keyed, once), JSON files and change messages, for batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Kept with each record of a sink that is read once: the batch, and the record's number in it.
ONCE = "record-id"


def records(rows: DataFrame, key: str | None = None) -> DataFrame:
    """value (JSON of all columns, nulls left out) and, if asked for, key (text): what a topic's records say.

    A null key is a record without a key; rows without columns can't be written.
    """
    value = F.to_json(F.struct(*rows.columns)).alias("value")
    return rows.select(value) if key is None else rows.select(F.col(key).cast("string").alias("key"), value)


def kafka_options(servers: str, topic: str, once: bool = False, **more: str) -> dict[str, str]:
    """Options of a topic to write to. once: acknowledged by all replicas and not repeated by the producer itself."""
    out = {"kafka.bootstrap.servers": servers, "topic": topic}
    return out | ({"kafka.acks": "all", "kafka.enable.idempotence": "true", "includeHeaders": "true"} if once else {}) | more


def kafka_stream(rows: DataFrame, options: dict[str, str], checkpoint: str, key: str | None = None) -> DataStreamWriter:
    """A stream to a topic, at least once. Needs the Kafka connector on the class path."""
    return records(rows, key).writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).outputMode("append")


def numbered(batch: DataFrame, batch_id: int, key: str | None = None) -> DataFrame:
    """records() of a micro-batch with a header that names each: its batch and a digest of what it says and of its number
    among equal records.

    A batch that Spark repeats after a failure gives the same names, so a reader that takes a name once (first_records)
    sees every record exactly once, whatever the producer had sent before it was lost.
    """
    said = records(batch, key)
    columns = said.columns
    again = F.row_number().over(W.partitionBy(*columns).orderBy(F.lit(0)))
    name = F.concat(F.lit(f"{batch_id}-"), F.sha2(F.to_json(F.struct(*columns, again.alias("n"))), 256))
    header = F.struct(F.lit(ONCE).alias("key"), name.cast("binary").alias("value"))
    return said.withColumn("headers", F.array(header))


def kafka_once(rows: DataFrame, options: dict[str, str], checkpoint: str, key: str | None = None, write: Callable[[DataFrame], None] | None = None) -> DataStreamWriter:
    """A stream to a topic whose records are named by batch, for readers that take each once. write: stands in for Kafka."""

    def send(batch: DataFrame, batch_id: int) -> None:
        out = numbered(batch, batch_id, key)
        if write:
            write(out)
        else:
            out.write.format("kafka").options(**options).save()

    return rows.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).outputMode("append")


def record_id(headers: str = "headers") -> Column:
    return F.element_at(F.filter(headers, lambda h: h["key"] == ONCE), 1)["value"].cast("string")


def first_records(rows: DataFrame) -> DataFrame:
    """One record of each name; records without a name are all kept. Batch form; a stream uses dropDuplicatesWithinWatermark."""
    named = rows.withColumn("_id", record_id())
    return named.where("_id IS NOT NULL").dropDuplicates(["_id"]).unionByName(named.where("_id IS NULL")).drop("_id")


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; nulls are left out, as the readers expect."""
    rows.write.mode(mode).json(path)


def json_stream(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream to JSON lines, each row once: the folder's log tells which files count."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
