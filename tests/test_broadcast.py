"""Fan-out of batches larger than the capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.streaming.pipelines import Broadcast


def test_a_quiet_receiver_gets_its_rows_from_a_large_batch(spark):
    batch = spark.range(50, numPartitions=3).withColumn("tenant", F.when(F.col("id") >= 47, "quiet").otherwise("busy"))
    hub = Broadcast(capacity=5)
    quiet, every = hub.subscribe(lambda r: r["tenant"] == "quiet"), hub.subscribe()
    hub(batch, 0)
    assert [r["id"] for r in quiet] == [47, 48, 49]
    assert [r["id"] for r in every] == [45, 46, 47, 48, 49]
