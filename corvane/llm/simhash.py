"""Near duplicates by SimHash: fingerprints of word shingles, linked by BK-trees over shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import checkpoint, fresh, table
from corvane.llm.components import components

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64
#: Shingles whose bits are counted at a time, fingerprints of a shard beyond which it is cut again,
#: keys of two integers up to which they are broadcast.
COUNTED, SHARD, BROADCAST = 1 << 16, 1 << 14, 200_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint of a text; 0 for null and for a text without words.

    A-Z go to lower case, words end at ASCII white space, shingles keep repeats and a text of fewer words is one shingle.
    A bit is set if it is in over half of the shingles' hashes.
    """
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    if len(ws) <= width:
        return xxhash.xxh64_intdigest(b" ".join(ws), SEED)
    digest, n, ones = xxhash.xxh64_digest, len(ws) - width + 1, np.zeros(BITS, np.int64)
    for at in range(0, n, COUNTED):
        runs = [ws[at + k : min(at + COUNTED, n) + k] for k in range(width)]
        raw = b"".join([digest(b" ".join(s), SEED) for s in zip(*runs, strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint", keep: bool = True) -> DataFrame:
    """Adds ``into``: the fingerprint as a signed 64-bit integer. keep: with the text."""
    (into,) = fresh(docs, into)
    held = [f for f in docs.schema.fields if keep or f.name != text]
    places, where = [docs.columns.index(f.name) for f in held], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(where)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(found)], names=[*(f.name for f in held), into])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held), f"`{into}` bigint"]))


class BKTree:
    """Integers by Hamming distance: a node's children are keyed by their distance to it."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node, children = self.root
        while True:
            d = (node ^ value).bit_count()
            if d == 0:
                return
            below = children.get(d)
            if below is None:
                children[d] = (value, {})
                return
            node, children = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The values within ``radius``; only edges whose key is within ``radius`` of the parent's distance are followed."""
        todo = [self.root] if self.root else []
        while todo:
            node, children = todo.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                yield node
            if children:
                for key in range(d - radius, d + radius + 1):
                    if key in children:
                        todo.append(children[key])


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """Shift and mask of each of ``parts`` blocks of an integer of ``bits`` bits."""
    edges = [round(k * bits / parts) for k in range(parts + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _bits(col, shift: int, mask: int):
    return F.shiftrightunsigned(col, shift).bitwiseAND(F.lit(mask))


def shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """a, b: for every shard (columns shard, fp, stored), links that join what is within ``radius`` there.

    Rows are dealt by shard and sorted, so a task holds one shard's tree at a time. stored rows make the tree; the others
    only ask it. A value that asks is linked to one value of each group that it meets, so a tight group of n values gives
    n links, not n squared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shard, up, links = BKTree(), None, {}, []

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for key, fp, stored in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != shard:
                    tree, shard, up = BKTree(), key, {}
                value = fp & 0xFFFFFFFFFFFFFFFF
                for other in tree.within(value, radius):
                    if (a := top(other)) != (b := top(value)):
                        up[a] = b
                        links.append((fp, other if other < 1 << 63 else other - (1 << 64)))
                if stored:
                    tree.add(value)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])
                links = []

    dealt = shards.select("shard", "fp", "stored").repartition("shard").sortWithinPartitions("shard", F.desc("stored"), "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def links(fps: DataFrame, radius: int = RADIUS, shard_size: int = SHARD) -> DataFrame:
    """a, b: links that connect exactly what chains of distances up to ``radius`` connect among the distinct ``fp``.

    Two values within ``radius`` agree in one of ``radius`` + 1 blocks of their bits, so each block's value names a shard
    and every pair meets in a shard of its own. A shard of more than ``shard_size`` values is cut again by blocks of its
    other bits, then once more by hash: each of its parts stores its values in a tree that the values of the
    parts after it ask.
    """
    fps = fps.select("fp").distinct()
    first = _blocks(BITS, radius + 1)
    rows = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("block"), _bits(F.col("fp"), *b).alias("key")) for k, b in enumerate(first)))).alias("s"))
    rows = rows.select("fp", F.col("s.block").alias("block"), F.col("s.key").alias("key"))
    sizes = rows.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = checkpoint(rows.join(sizes, ["block", "key"]))
    small = rows.where(F.col("n") <= shard_size).select(F.xxhash64("block", "key").alias("shard"), "fp", F.lit(True).alias("stored"))

    large = rows.where(F.col("n") > shard_size)
    deeper = []
    for k, (shift, mask) in enumerate(first):
        # The bits outside the block, moved together: those above it come down over it.
        low = F.col("fp").bitwiseAND(F.lit((1 << shift) - 1))
        high = F.shiftrightunsigned("fp", shift + mask.bit_length()) if shift + mask.bit_length() < BITS else F.lit(0).cast("long")
        packed = F.shiftleft(high, shift).bitwiseOR(low)
        again = F.array(*(F.struct(F.lit(j).alias("sub"), _bits(packed, *b).alias("subkey")) for j, b in enumerate(_blocks(BITS - mask.bit_length(), radius + 1))))
        deeper.append(large.where(F.col("block") == k).select("fp", "block", "key", F.explode(again).alias("s")))
    cut = deeper[0]
    for x in deeper[1:]:
        cut = cut.unionByName(x)
    cut = cut.select("fp", F.xxhash64("block", "key", "s.sub", "s.subkey").alias("shard"))
    n = cut.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    cut = cut.join(n, "shard")
    parts = F.ceil(F.col("n") / shard_size).cast("int")
    home = F.pmod(F.xxhash64("fp", F.lit(1)), parts)
    # Stored in its own part's tree, asking those of the parts before it: each pair meets once.
    cut = cut.select("fp", "shard", home.cast("int").alias("home"))
    cut = cut.select("fp", "shard", "home", F.explode(F.sequence(F.lit(0), F.col("home"))).alias("part")).select(F.xxhash64("shard", "part").alias("shard"), "fp", (F.col("home") == F.col("part")).alias("stored"))
    return shard_links(small.unionByName(cut), radius)


def _grouped(docs: DataFrame, doc_id: str, text: str, radius: int) -> DataFrame:
    """doc_id, th (hash of the text), fp, root (the component's smallest fingerprint), component_id for every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    rows = checkpoint(with_fingerprint(rows, "t", "fp", keep=False))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes, radius))
    # Only groups of several fingerprints have a root; every other fingerprint is its own group.
    grouped = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(grouped.join(named, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked if their fingerprints differ in at most ``radius`` bits; component_id is the smallest doc_id that
    links reach. Equal fingerprints are taken together first, so a group of copies is one node. Null and empty texts have
    the fingerprint zero and are linked like any other. A component of null ids only has a null component_id; repeated
    rows stay; an empty table gives no rows.
    """
    found = _grouped(docs, doc_id, text, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component that with the smallest doc_id stays.

    Null ids come last, equal ids go by the hash of their texts, and of repeated rows one stays.
    """
    return keep_best(docs, _grouped(docs, doc_id, text, radius), doc_id, text)


def keep_best(docs: DataFrame, grouped: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of ``docs`` a root of ``grouped`` (root, doc_id, th for every row), by the order that keep_one() states."""
    found = checkpoint(grouped.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n")))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("kept"))
    judged = found.join(best, "root").withColumn("stays", F.col("kept.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("kept.th") == F.col("th")))
    i, h = fresh(docs, "_i", "_h")
    key = lambda df: df.select(F.col("doc_id").alias(i), F.col("th").alias(h))
    match = F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h))
    # Texts are shuffled only where the rows that go are too many to broadcast.
    kept = docs.join(_bounded(key(judged.where("NOT stays"))), match, "left_anti")
    repeated = _bounded(key(judged.where("stays AND n > 1")))
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, match, "left_anti").unionByName(kept.join(repeated, match, "left_semi").dropDuplicates([doc_id, text]))


def _bounded(keys: DataFrame) -> DataFrame:
    """``keys`` to be broadcast if they are few, else to be joined by a shuffle."""
    keys = checkpoint(keys)
    return F.broadcast(keys) if keys.limit(BROADCAST + 1).count() <= BROADCAST else keys


def query(spark, sf_dir):
    """op10: doc_id, fingerprint, component_id for every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
