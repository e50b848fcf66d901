"""What the operators of this folder share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator here, for a regular expression's brackets: \x20 and \x09 to \x0D.
SPACE = r" \x09-\x0D"
#: The characters a word is made of.
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = _local(spark)
    return found.rstrip("/")


def _local(spark: SparkSession) -> str:
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = spark.sparkContext.getCheckpointDir()
    if not where:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/corvane-{kind}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``'s."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out



def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back to the system when its task ends: workers outlive their tasks,
    and several share a machine."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return ended


#: Bits of a sieve: 2 MB, whatever it is made of.
SIEVE = 1 << 24


def mixed(codes: np.ndarray) -> np.ndarray:
    """64-bit codes, well mixed. The finishing steps of a 64-bit mixer."""
    x = codes.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sieve(codes: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> np.ndarray:
    """A table of SIEVE bits that has the bit of every code in ``codes``, as 64-bit words. of: the codes of a batch (else
    its first column, a bigint).

    Broadcast, it keeps most rows that have no counterpart in ``codes`` from a shuffle; the join behind it decides. What
    comes to the driver is SIEVE / 64 words at most. The more codes, the less it holds back; it never holds back a match.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SIEVE // 64, np.uint64)
        for batch in batches:
            at = mixed(of(batch) if of else batch.column(0).to_numpy()) % np.uint64(SIEVE)
            np.bitwise_or.at(held, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some].astype(np.int64))], names=["at", "word"])

    out = np.zeros(SIEVE // 64, np.uint64)
    found = codes.mapInArrow(bits, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out[found["at"].to_numpy()] = found["word"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def holder(table: np.ndarray) -> Callable[[int], bool]:
    """passes() for one code at a time."""
    raw, full = table.astype("<u8").tobytes(), (1 << 64) - 1

    def may(code: int) -> bool:
        x = (code + 0x9E3779B97F4A7C15) & full
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        at = (x ^ x >> 31) % SIEVE
        return bool(raw[at >> 3] >> (at & 7) & 1)

    return may


def passes(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which codes may be in the sieve ``table``."""
    at = mixed(codes) % np.uint64(SIEVE)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def sifted(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """The rows of ``df`` whose bigint ``column`` may be in ``codes``."""
    sent, at, names = df.sparkSession.sparkContext.broadcast(sieve(codes)), df.columns.index(column), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(passes(sent.value, batch.column(at).to_numpy(zero_copy_only=False)))
            if len(keep):
                yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in batch.columns], names=names)

    return df.mapInArrow(run, df.schema)
