"""Identity resolution: anonymous and signed-in ids of a tenant to one canonical id, as a batch without a sequential scan.

The rule, event by event in arrival order, with A[anonymous] and U[user] of a tenant: a known user wins; else the device's
canonical id is taken, or a new one; the first login binds the user to the device's canonical id; a device whose canonical
id differs from a known user's is re-pointed and a merge is told. Merges aren't transitive and history isn't rewritten.

In batch that is a forest. The canonical id of a user is fixed at its first event: it is the canonical id of the user last
seen on the same device before, if any, and else the id made at the device's first event. First events strictly go back,
so pointers are followed by doubling, in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.columns import deterministic_id, present
from corvane.operators.state import checkpoint


#: Signed-in users up to which their canonical ids are broadcast.
BROADCAST = 200_000


def user_canonicals(placed: DataFrame, rounds: int = 64) -> DataFrame:
    """tenant_id, user, canon, first_seq for every signed-in user of ``placed`` (see resolve)."""
    first = placed.where(present("user_id")).groupBy("tenant_id", "user_id").agg(F.min_by(F.struct("prev_user", "device_new_id"), "seq").alias("f"), F.min("seq").alias("first_seq"))
    users = first.select("tenant_id", F.col("user_id").alias("user"), "first_seq", F.col("f.prev_user").alias("up"), F.when(F.col("f.prev_user").isNull(), F.col("f.device_new_id")).alias("canon"))
    users = checkpoint(users)
    for _ in range(rounds):
        if users.where("canon IS NULL").isEmpty():
            return users.select("tenant_id", "user", "canon", "first_seq")
        above = users.select(F.col("tenant_id").alias("t"), F.col("user").alias("u"), F.col("up").alias("up2"), F.col("canon").alias("canon2"))
        done = users.where("canon IS NOT NULL")
        todo = users.where("canon IS NULL").join(above, (F.col("tenant_id") == F.col("t")) & (F.col("up") == F.col("u")), "left")
        users = checkpoint(done.unionByName(todo.select("tenant_id", "user", "first_seq", F.col("up2").alias("up"), F.col("canon2").alias("canon"))))
    raise RuntimeError("identity pointers did not settle")


def resolve(events: DataFrame) -> DataFrame:
    """``events`` (raw columns and seq) with canonical_id and merge_old: the one capture that the projections read."""
    device = W.partitionBy("tenant_id", "anonymous_id").orderBy("seq")
    user = F.when(present("user_id"), F.col("user_id"))
    placed = events.withColumns({
        "prev_user": F.last(user, ignorenulls=True).over(device.rowsBetween(W.unboundedPreceding, -1)),
        "device_first": F.first("event_id").over(device.rowsBetween(W.unboundedPreceding, 0)),
        "is_first": F.row_number().over(device) == 1,
    })
    placed = placed.withColumn("device_new_id", deterministic_id("tenant_id", "device_first"))
    canon = user_canonicals(placed)
    if canon.limit(BROADCAST + 1).count() <= BROADCAST:
        canon = F.broadcast(canon)  # else the events are dealt by user twice
    own = canon.select(F.col("tenant_id").alias("t1"), F.col("user").alias("u1"), F.col("canon").alias("own"), "first_seq")
    past = canon.select(F.col("tenant_id").alias("t2"), F.col("user").alias("u2"), F.col("canon").alias("past"))
    joined = placed.join(own, (F.col("tenant_id") == F.col("t1")) & (F.col("user_id") == F.col("u1")), "left")
    joined = joined.join(past, (F.col("tenant_id") == F.col("t2")) & (F.col("prev_user") == F.col("u2")), "left")
    before = F.coalesce("past", F.when(~F.col("is_first"), F.col("device_new_id")))
    found = joined.withColumn("before", before)
    merges = present("user_id") & F.col("before").isNotNull() & (F.col("first_seq") < F.col("seq")) & (F.col("before") != F.col("own"))
    return found.select(*events.columns, F.coalesce("own", "before", "device_new_id").alias("canonical_id"), F.when(merges, F.col("before")).alias("merge_old"))


def unified(capture: DataFrame) -> DataFrame:
    """The 17 columns and the two that order them."""
    return capture.drop("merge_old")


def merges(capture: DataFrame) -> DataFrame:
    return capture.where("merge_old IS NOT NULL").select(F.col("merge_old").alias("old_canonical_id"), "canonical_id", "tenant_id", F.col("event_time").alias("merged_at"))
