"""Packing by optimal length buckets: boundaries that minimise padding, and batches of a token budget inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.llm.bpe import sequences
from corvane.llm.common import checkpoint, fresh, table

#: Longest sequence, buckets, tokens a batch, sequences numbered by one task.
MAX_LENGTH, BUCKETS, BUDGET, NUMBERED = 2048, 8, 65536, 2048


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that together pad least, for ascending distinct lengths with counts.

    Dynamic programming: cost[k][j], the least padded size of the first j lengths in k buckets, is the least over i of
    cost[k-1][i] plus bound j times the sequences between; O(buckets * lengths^2) with lengths at most MAX_LENGTH + 1.
    Of equal plans the one whose last bucket begins earliest is taken.
    """
    if not lengths:
        return []
    bound = np.array(lengths, np.float64)
    seen = np.concatenate([[0], np.cumsum(np.array(counts, np.float64))])
    n = len(lengths)
    cost = np.concatenate([[0], np.full(n, np.inf)])
    back = []
    for _ in range(min(buckets, n)):
        new, where = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        for j in range(1, n + 1):
            options = cost[:j] + bound[j - 1] * (seen[j] - seen[:j])
            where[j] = int(options.argmin())
            new[j] = options[where[j]]
        back.append(where)
        cost = new
    out, j = [], n
    for where in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(where[j])
    return out[::-1]


def pack(rows: DataFrame, n_tokens: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET, numbered: int = NUMBERED) -> DataFrame:
    """Adds bucket_length and batch_id to sequences (rows with a bounded integer ``n_tokens``, at most MAX_LENGTH).

    Boundaries come from the histogram of all rows, which has one entry a length. Within a bucket, sequences get places
    0, 1, 2 ... and batch b holds the places from b * size on, where size * bucket_length is within ``budget`` (one
    sequence at least): every batch but a bucket's last is full. batch_id counts through the buckets from short to long.

    A bucket is dealt over as many parts as ``numbered`` goes into its count; places are numbered inside the parts and
    shifted by the counts of the parts before, so a bucket with most of the rows isn't sorted by one task. Parts go by the
    hash of the whole row, so equal rows get neighbouring places, in any order. Null lengths count as zero; an empty table
    stays empty.
    """
    spark = rows.sparkSession
    bucket_c, batch_c = fresh(rows, "bucket_length", "batch_id")
    length, part, n_in, shift, at, size, first, b, p = fresh(rows, "_length", "_part", "_n", "_shift", "_at", "_size", "_first", "_b", "_p")
    own = rows.columns
    # The histogram and the batches both need the lengths: they are counted once.
    rows = checkpoint(rows.withColumn(length, F.coalesce(F.col(n_tokens).cast("long"), F.lit(0).cast("long"))))
    histogram = rows.groupBy(length).count().orderBy(length).limit((1 << 16) + 1).collect()
    if len(histogram) > 1 << 16:
        raise ValueError("cut texts into sequences first: more than 65,536 distinct lengths")
    counts = {r[length]: r["count"] for r in histogram}
    bounds = optimal_boundaries(list(counts), list(counts.values()), buckets)
    plan, start, low = [], 0, -1
    for bound in bounds:
        n = sum(c for k, c in counts.items() if low < k <= bound)
        per = max(1, budget // max(bound, 1))
        plan.append((bound, per, start, max(1, -(-n // numbered))))
        start, low = start + -(-n // per), bound
    if not plan:
        plan = [(0, 1, 0, 1)]

    def chosen(k: int) -> Column:
        """Entry k of the plan of a row's bucket; the plan is a few literals, so no join."""
        out = F.lit(plan[-1][k])
        for entry in reversed(plan[:-1]):
            out = F.when(F.col(length) <= entry[0], F.lit(entry[k])).otherwise(out)
        return out

    rows = rows.withColumns({bucket_c: chosen(0).cast("long"), size: chosen(1).cast("long"), first: chosen(2).cast("long"), part: F.pmod(F.xxhash64(*own), chosen(3).cast("long"))})
    sums = rows.groupBy(bucket_c, part).agg(F.count("*").alias(n_in))
    before = W.partitionBy(bucket_c).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col(bucket_c).alias(b), F.col(part).alias(p), F.coalesce(F.sum(n_in).over(before), F.lit(0)).alias(shift))
    placed = rows.withColumn(at, F.row_number().over(W.partitionBy(bucket_c, part).orderBy(F.xxhash64(*own, F.lit(1)))) - 1)
    placed = placed.join(sums, (F.col(bucket_c) == F.col(b)) & (F.col(part) == F.col(p)))
    batch = F.col(first) + F.floor((F.col(shift) + F.col(at)) / F.col(size))
    return placed.select(*own, bucket_c, batch.cast("long").alias(batch_c))


def pack_texts(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", max_length: int = MAX_LENGTH) -> DataFrame:
    """doc_id, chunk, start, n_tokens, ids, bucket_length, batch_id: texts as token sequences (see bpe.sequences), packed.

    The rows of a batch_id, with their ids (bpe.unpacked reads them), are a batch to train on: pad each to bucket_length.
    """
    return pack(sequences(docs, path, pattern, max_length, doc_id, text))


def query(spark, sf_dir):
    """op3: doc_id, chunk, start, n_tokens, ids, bucket_length, batch_id for every sequence of every document's tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
