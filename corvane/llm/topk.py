"""Exact top-k by inner product in three phases with a uniform threshold.

A vector's components are dealt into slices; a slice's partial inner products are the local scores of one list. Phase 1
gathers, from every block of candidates, the best entries of every list and completes their scores: the k-th best of
these is a score that at least k candidates reach, a safe cutoff. Phase 2 broadcasts the cutoffs: a score that reaches
cutoff c has a partial of c divided by the number of slices or more, so only such entries are collected. Phase 3 adds
their remaining partials and keeps what reaches the cutoff. Then k rows a query are taken, ties to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.llm.common import checkpoint, scratch, table

K, SLICES, SCALE = 5, 4, 256
#: Bytes of the query vectors that are broadcast at once, and candidates scored at once.
QUERY_BYTES, BLOCK = 1 << 24, 4096


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v: array<bigint> of floor(scale * component). Vectors that are null or hold null or non-finite parts go."""
    x = F.col(embedding)
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vectors.where(whole & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as int64: by floats where their 53 bits hold every partial sum."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Row and column pairs that hold each row's k largest values (all, if fewer)."""
    if score.shape[1] <= k:
        cols = np.tile(np.arange(score.shape[1]), (len(score), 1))
    else:
        cols = np.argpartition(score, score.shape[1] - k, axis=1)[:, -k:]
    return np.stack([np.repeat(np.arange(len(score)), cols.shape[1]), cols.ravel()])


def _first(rows: np.ndarray, cols: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k first entries by score, then id: ties may be many, and only these can be among the k first of all."""
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep], score[keep]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and matrices of candidates, a matrix for each length of vector."""
    held: dict[int, list] = {}

    def pack(rows: list) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])

    for batch in batches:
        ids, col = batch.column(0).to_numpy(), batch.column(1)
        lengths = np.diff(col.offsets.to_numpy())
        flat = col.flatten().to_numpy()
        starts = np.cumsum(lengths) - lengths
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            matrix = flat[starts[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0), np.int64)
            rows = held.setdefault(int(n), [])
            rows.append((ids[at], matrix))
            if sum(len(r[0]) for r in rows) >= size:
                yield pack(held.pop(int(n)))
    for rows in held.values():
        yield pack(rows)


def _cuts(n: int, slices: int) -> list[slice]:
    edges = np.linspace(0, n, min(slices, max(n, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _run(of: Callable, block: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in _blocks(batches, block):
            for q, c, s in of(ids, matrix):
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def _phases(candidates: DataFrame, queries: list, k: int, slices: int, block: int) -> DataFrame:
    """query_id, rank, vec_id, score for a bounded block of queries (rows of id and vector)."""
    spark = candidates.sparkSession
    by_length: dict[int, tuple[list, list]] = {}
    for vec_id, v in queries:
        a, b = by_length.setdefault(len(v), ([], []))
        a.append(vec_id)
        b.append(v)
    sent = spark.sparkContext.broadcast({n: (np.array(a, np.int64), np.array(b, np.int64).reshape(len(a), n)) for n, (a, b) in by_length.items()})

    def gather(ids, matrix):
        q_ids, q = sent.value.get(matrix.shape[1], (np.zeros(0, np.int64), None))
        for at in range(0, len(q_ids), 512):
            some = q[at : at + 512]
            lists = [_exact(some[:, cut], matrix[:, cut]) for cut in _cuts(matrix.shape[1], slices)]
            found = []
            own = q_ids[at : at + 512][:, None] == ids
            for part in lists:
                part[own] = np.iinfo(np.int64).min // 2
                found.append(_best(part, k))
            rows, cols = np.unique(np.concatenate(found, axis=1), axis=1)
            keep = ~own[rows, cols]
            rows, cols = rows[keep], cols[keep]
            # Only what a list gave gets its whole score.
            rows, cols, score = _first(rows, cols, sum(part[rows, cols] for part in lists), ids, k)
            yield q_ids[at : at + 512][rows], ids[cols], score

    schema = "query_id bigint, vec_id bigint, score bigint"
    first = candidates.mapInArrow(_run(gather, block), schema)
    ordered = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") == k)
    cutoffs = {r["query_id"]: r["score"] for r in kth.select("query_id", "score").collect()}  # at most one row a query of the block
    safe = spark.sparkContext.broadcast(cutoffs)

    def resolve(ids, matrix):
        q_ids, q = sent.value.get(matrix.shape[1], (np.zeros(0, np.int64), None))
        low = np.array([safe.value.get(i, -(1 << 62)) for i in q_ids.tolist()], np.int64)
        if len(q_ids):
            # A score is at most the product of the lengths: queries that no vector of the block can serve are passed over.
            may = np.linalg.norm(q.astype(np.float64), axis=1) * np.linalg.norm(matrix.astype(np.float64), axis=1).max(initial=0) * (1 + 1e-9) + 1 >= low
            q_ids, q, low = q_ids[may], q[may], low[may]
        for at in range(0, len(q_ids), 512):
            some, cut_off = q[at : at + 512], low[at : at + 512, None]
            cuts = _cuts(matrix.shape[1], slices)
            lists = [_exact(some[:, cut], matrix[:, cut]) for cut in cuts]
            # ceil(cutoff / slices): the largest partial of a score that reaches the cutoff is no smaller.
            enough = -(-cut_off // len(cuts))
            collected = lists[0] >= enough
            for part in lists[1:]:
                collected |= part >= enough
            collected &= q_ids[at : at + 512][:, None] != ids
            rows, cols = np.nonzero(collected)
            score = sum(part[rows, cols] for part in lists)
            keep = score >= cut_off[rows, 0]
            rows, cols, score = _first(rows[keep], cols[keep], score[keep], ids, k)
            yield q_ids[at : at + 512][rows], ids[cols], score

    found = candidates.mapInArrow(_run(resolve, block), schema)
    return found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, slices: int = SLICES, query_bytes: int = QUERY_BYTES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates by inner product, exactly.

    Both inputs as quantised() gives them: vec_id, v. Only vectors of a query's length are its candidates; those with the
    query's vec_id are its own and aren't. Every row counts, repeated ones too, as in sql(). Ties go to the smaller vec_id.
    No queries or no candidates give no rows. Scores are int64.

    Query vectors are broadcast ``query_bytes`` at a time, so what is broadcast doesn't grow with the data; each block of
    queries passes over all candidates twice and is written to the shared folder before the next when there are several.
    """
    spark = candidates.sparkSession
    empty = spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    candidates = checkpoint(candidates)
    held, size, wrote, path = [], 0, 0, scratch(spark, "topk")
    for row in queries.toLocalIterator(prefetchPartitions=True):
        held.append((row["vec_id"], np.array(row["v"], np.int64)))
        size += held[-1][1].nbytes + 8
        if size >= query_bytes:
            _phases(candidates, held, k, slices, block).write.mode("append").parquet(path)
            held, size, wrote = [], 0, wrote + 1
    last = _phases(candidates, held, k, slices, block) if held else empty
    if not wrote:
        return last
    # Rows of one query_id may lie in several blocks.
    ordered = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return last.unionByName(spark.read.parquet(path)).withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)


def query(spark, sf_dir):
    """op9: query_id, rank, vec_id, score; queries are the vectors whose id is divisible by 50."""
    vectors = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def sql() -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}"""
