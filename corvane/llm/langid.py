"""Language by rank-order profiles: out-of-place distance between a text's most frequent n-grams and each language's."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.llm.common import table

#: Lengths of the n-grams, entries of a profile, code points counted at a time.
ORDERS, TOP, CHUNK = (1, 2, 3), 400, 1 << 20
#: Distinct n-grams of a language that a task may hold before it passes its counts on.
HELD = 1 << 20


@functools.lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """By code point: its lower case where that is one letter, itself for other letters, 0 for all else."""
    out = np.zeros(0x110000, np.uint64)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-grams as integers of 21 bits a letter, 0 between words, and their counts; chunk by chunk for long texts."""
    codes = counts = None
    tail = np.zeros(1, np.uint64)
    for at in range(0, len(text), CHUNK):
        part = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.concatenate([tail, _folded()[part]])
        if at + CHUNK >= len(text):
            letters = np.append(letters, np.uint64(0))
        # A run of other characters counts as one gap.
        keep = letters != 0
        keep[1:] |= letters[:-1] != 0
        keep[0] = True
        letters = letters[keep]
        new_from = len(tail) - 1 if at else 0
        found = []
        for n in ORDERS:
            if len(letters) < n:
                continue
            gram = np.zeros(len(letters) - n + 1, np.uint64)
            for k in range(n):
                gram = (gram << np.uint64(21)) | letters[k : len(letters) - n + 1 + k]
            if at:  # those that end within the tail were counted with the chunk before
                gram = gram[max(0, new_from - n + 2) :]
            middle = gram if n == 1 else gram[(gram & np.uint64((1 << 42) - 1)) != 0] if n == 3 else gram
            found.append(middle[middle != 0])
        tail = letters[-2:]
        one, n_one = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        if codes is None:
            codes, counts = one, n_one
        else:
            both, where = np.unique(np.concatenate([codes, one]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n_one]), len(both)).astype(np.int64)
            codes = both
    if codes is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return codes, counts


def _ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, best first; ties to the smaller code."""
    return codes[np.lexsort((codes, -counts))[:top]]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """Profiles: by language, its ``top`` most frequent n-grams over all rows whose text and lang aren't null.

    Counts cover every text whole and are summed by task first, then by n-gram, so a language with most of the rows is
    dealt like any other. What comes to the driver is ``top`` integers a language. No labelled rows: no profiles.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}

        def flush(name: str) -> pa.RecordBatch:
            codes, where = np.unique(np.concatenate([c for c, _ in sums[name]]), return_inverse=True)
            n = np.bincount(where, np.concatenate([k for _, k in sums[name]]), len(codes)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                codes, n = _grams(t.as_py())
                held = sums.setdefault(name, [])
                held.append((codes, n))
                if len(held) >= 256:
                    merged, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
                    sums[name] = [(merged, np.bincount(where, np.concatenate([k for _, k in held]), len(merged)).astype(np.int64))]
                    if len(merged) > HELD:
                        yield flush(name)
                        del sums[name]
        for name in list(sums):
            yield flush(name)

    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    grams = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy(F.desc("n"), "gram"))
    # First among a sixty-fourth of a language's n-grams, then among those that are left: no task ranks a whole language.
    grams = grams.withColumn("part", F.abs(F.hash("gram")) % 64)
    grams = grams.withColumn("r", best("part")).where(F.col("r") <= top).withColumn("r", best()).where(F.col("r") <= top)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in grams.select("lang", "gram", "r").collect():  # at most ``top`` rows a language
        profiles.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return {k: [g for _, g in sorted(v)] for k, v in sorted(profiles.items())}


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", top: int = TOP, keep: bool = True) -> DataFrame:
    """Adds lang_pred and score.

    The distance to a language is the sum, over the text's ``top`` n-grams, of how far each is out of its place in the
    profile, at most ``top`` each. The nearest wins, ties to the first name. score is 1 less the winner's distance as a
    share of the largest possible. Null texts, texts without a letter and any text without profiles get ``und`` and 0.
    Rows are judged alone by their text only; other columns pass through.

    keep: with the text.
    """
    names = list(profiles)
    known = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
    place = np.full((len(known) + 1, len(names)), -1, np.int64)
    for k, p in enumerate(profiles.values()):
        place[np.searchsorted(known, np.array(p, np.uint64)), k] = np.arange(len(p))

    def of(t: str | None) -> tuple[str, float]:
        codes, counts = _grams(t) if t else ((), ())
        if not len(codes) or not names:
            return "und", 0.0
        own = _ranked(codes, counts, top)
        at = np.searchsorted(known, own)
        at[(at >= len(known)) | (known[np.minimum(at, len(known) - 1)] != own)] = len(known)
        there = place[at]
        off = np.minimum(np.abs(there - np.arange(len(own))[:, None]), top)
        off[there < 0] = top
        total = off.sum(axis=0)
        best = int(total.argmin())
        return names[best], 1 - float(total[best]) / (top * len(own))

    held = [f for f in docs.schema.fields if keep or f.name != text]
    places, where = [docs.columns.index(f.name) for f in held], docs.columns.index(text)
    from corvane.llm.common import fresh

    added = fresh(docs, "lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(t.as_py()) for t in batch.column(where)]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *more], names=[*(f.name for f in held), *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held), f"{added[0]} string, {added[1]} double"])
    return docs.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def query(spark, sf_dir):
    """op7: doc_id, held_out, lang_pred, score; learns from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.where(fold(F.col("doc_id")) != 1))
    return predict(docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "text"), profiles, keep=False)
