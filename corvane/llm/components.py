"""Connected components of a graph given by its edges: by one task if they are few, else by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import checkpoint

#: Edges up to which one task joins them all; a few tens of MB.
SMALL = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of edges a, b by union-find; the smaller root stays."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (a := top(a)) != (b := top(b)):
                up[max(a, b)] = min(a, b)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 60, small: int = SMALL) -> DataFrame:
    """node, root (the smallest node of its component) for every node of an edge (columns a, b; integers or ASCII text).

    Up to ``small`` edges, by their count, are joined by one task. Beyond that, each round hangs every node's larger
    neighbours on its smallest neighbour, then every node and its smaller ones on the smallest; stars are the fixed point,
    reached in about log(n) rounds. Neighbour lists are never gathered: the smallest neighbour is an aggregate, and it is
    joined back to the edges. Each round ends in a checkpoint in the shared folder. Both ways give the same rows.
    Loops and nulls are no edges, repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = checkpoint(e)
    if e.limit(small + 1).count() <= small:
        kind = e.schema["a"].dataType.simpleString()
        return checkpoint(e.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"))
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        near = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        own = near.join(least, "a")
        hung = own.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpoint(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        # A star forest has one edge a node and no centre that is itself a leaf.
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
