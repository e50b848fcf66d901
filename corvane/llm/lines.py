"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line kept a group.

A line's SimHash over its words is cut into five blocks, and each choice of two blocks is a mask: two SimHashes within
three bits agree under one of the ten masks at least, and farther ones often do. Lines that agree under a mask and differ
in at most REACH bits are candidates, and the edit similarity decides.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import checkpoint, fresh, lean, mixed, passes, scratch, sieve, sifted, table
from corvane.llm.components import components

#: Bits within which a pair is sure to share a mask, blocks, bits within which such a pair is a candidate.
RADIUS, BLOCKS, REACH = 3, 5, 8
SIMILARITY, SEED, BITS = 0.8, 42, 64
#: Lines that a shard may hold before it is cut into parts, words hashed at a time, distinct lines that may count as very
#: frequent.
SHARD, HASHED, HOT = 1 << 15, 1 << 16, 2000

_DIGITS = bytes.maketrans(b"123456789", b"000000000")
# By byte: its eight bits as counters of 8 bits, the first bit in the lowest.
_LANES = np.array([sum(((b >> (7 - i)) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def normalise(line: bytes) -> list[bytes]:
    """The words of a line: A-Z in lower case, every digit as 0, white space aside."""
    return line.lower().translate(_DIGITS).split()


def line_hashes(counts: list[int], raw: bytes) -> np.ndarray:
    """Fingerprints of lines, given each line's number of words (under 256) and all words' 8-byte hashes in a row."""
    n = np.array(counts)
    lanes = _LANES[np.frombuffer(raw, np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.cumsum(n) - n, axis=0).view(np.uint8).reshape(len(n), BITS)
    return np.packbits(sums > (n // 2).astype(np.uint8)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _long_line(ws: list[bytes]) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(ws), HASHED):
        raw = b"".join([xxhash.xxh64_digest(w, SEED) for w in ws[at : at + HASHED]])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(ws)).tobytes(), "big")


class _Hasher:
    """Keys (128-bit hash of the normalised line) and fingerprints of lines, each distinct line of a batch hashed once.

    A word counts once a line, else a separator between all words would make every such line's fingerprint its own hash.
    """

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.keys, self.fps, self.counts, self.raw, self.words = [], [], [], [], 0

    def add(self, ws: list[bytes]) -> int:
        norm = b" ".join(ws)
        at = self.place.get(norm)
        if at is None:
            at = self.place[norm] = len(self.keys)
            self.keys.append(xxhash.xxh3_128_digest(norm, SEED))
            ws = dict.fromkeys(ws)
            if len(ws) >= 256:
                self.flush()
                self.fps.append(np.array([_long_line(list(ws))], np.uint64))
            else:
                digest = xxhash.xxh64_digest
                self.raw.append(b"".join([digest(w, SEED) for w in ws]))
                self.counts.append(len(ws))
                self.words += len(ws)
                if self.words >= HASHED:
                    self.flush()
        return at

    def flush(self) -> None:
        if self.counts:
            self.fps.append(line_hashes(self.counts, b"".join(self.raw)))
        self.counts, self.raw, self.words = [], [], 0

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        self.flush()
        keys = np.frombuffer(b"".join(self.keys), ">i8").reshape(-1, 2).astype(np.int64)
        return keys, (np.concatenate(self.fps) if self.fps else np.zeros(0, np.uint64)).astype(np.int64)


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, th, line_no, k1, k2, fp for every line with a word of ``docs`` (doc_id, th, text); and a line -1 a row, whose
    k1 is the number of such lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hasher, n_of, line_no, of = _Hasher(), [], [], []
            for text in batch.column(2):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().translate(_DIGITS).split(b"\n")
                before = len(of)
                line_no.append(-1)
                of.append(-1)
                for k, line in enumerate(raw):
                    if ws := line.split():
                        line_no.append(k)
                        of.append(hasher.add(ws))
                n_of.append(len(of) - before)
            keys, fps = hasher.done()
            of, n_of = np.array(of), np.array(n_of)
            keys = np.vstack([keys, np.zeros((1, 2), np.int64)])[of]
            keys[of < 0, 0] = n_of - 1
            fps = np.append(fps, 0)[of]
            back = pa.array(np.repeat(np.arange(len(n_of)), n_of))
            for at in range(0, len(of), 1 << 17):
                some = slice(at, at + (1 << 17))
                held = [batch.column(0).take(back[some]), batch.column(1).take(back[some]), pa.array(line_no[some], pa.int32())]
                yield pa.RecordBatch.from_arrays([*held, *(pa.array(x[some]) for x in (keys[:, 0], keys[:, 1], fps))], names=["doc_id", "th", "line_no", "k1", "k2", "fp"])

    return docs.select("doc_id", "th", "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th bigint, line_no int, k1 bigint, k2 bigint, fp bigint")


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of bits such that values within ``radius`` agree under one of them: each choice of blocks - radius blocks.

    They are the same at every size of the input; a value shares a mask's 25 or 26 bits with one in tens of millions.
    """
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    cut = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(cut, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def sharded(nodes: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """shard, fp, node of ``nodes`` (node, fp): all that share a mask meet in a shard, whose last four bits are the mask's number.

    A shard of more than about ``shard_size`` lines is cut into parts by hash: each part stores its own lines and is asked
    by those of the parts after it (as -1 - node), so every pair still meets, once, and no task holds more than a part's.
    Which shards are that large is told from a share of the lines, which decides nothing but the number of parts.
    """
    low = lambda hashed, k: hashed.bitwiseAND(F.lit(-16)).bitwiseOR(k)
    keys = F.array(*(low(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))), F.lit(k)) for k, m in enumerate(masks())))
    rows = nodes.select(F.explode(keys).alias("shard"), "fp", "node")
    share = max(1, min(64, shard_size // 256))
    told = rows.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_size // share)
    large = checkpoint(told.select("shard", F.ceil(F.col("n") * share / shard_size).cast("int").alias("parts")))
    if large.isEmpty():
        return rows
    rows = rows.join(large, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("home"))))
    shard = F.when(F.col("parts") > 1, low(F.xxhash64("shard", "part"), F.col("shard").bitwiseAND(F.lit(15)))).otherwise(F.col("shard"))
    return rows.select(shard.alias("shard"), "fp", F.when(F.col("home") == F.col("part"), F.col("node")).otherwise(-1 - F.col("node")).alias("node"))


def _runs(batches: Iterator[pa.RecordBatch], least: int = 1 << 17) -> Iterator[list[np.ndarray]]:
    """Batches sorted by their first column, merged so that none ends within a run of equal values."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(h[0]) for h in held) >= least:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield [c[:cut] for c in cols]
                held = [[c[cut:] for c in cols]]
            else:
                held = [cols]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _differing(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Differing bits; the view keeps the sign bit, whose count numpy would take of the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _first_shared(xor: np.ndarray, mask: np.ndarray | int) -> np.ndarray:
    """Whether ``mask`` is the first under which the values agree: elsewhere the pair is passed over as judged."""
    first = np.full(len(xor), -1)
    for k, m in reversed(list(enumerate(masks()))):
        first[(xor & np.int64(_signed(m))) == 0] = k
    return first == mask


def _near(shard: np.ndarray, fp: np.ndarray, stored: np.ndarray, reach: int = REACH, wide: int = 512) -> np.ndarray:
    """Which rows (sorted by shard) have a candidate in their shard, under its mask first; one of the two is stored there."""
    found, mask = np.zeros(len(fp), bool), shard & 15
    for o in range(1, min(wide, len(fp))):
        same = shard[o:] == shard[:-o]
        if not same.any():
            return found
        hit = np.flatnonzero(same & (stored[o:] | stored[:-o]) & (_differing(fp[o:], fp[:-o]) <= reach))
        hit = hit[_first_shared(fp[hit + o] ^ fp[hit], mask[hit])]
        found[hit] = True
        found[hit + o] = True
    # Longer runs: each row is held against what follows it beyond the nearest.
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    for a, b in itertools.pairwise(edges.tolist()):
        for k in range(a, b - wide):
            if found[k] and found[k + wide : b].all():
                continue
            rest = slice(k + wide, b)
            hit = np.flatnonzero((stored[rest] | stored[k]) & (_differing(fp[rest], fp[k]) <= reach))
            hit = hit[_first_shared(fp[rest][hit] ^ fp[k], int(mask[k]))]
            if len(hit):
                found[k] = True
                found[k + wide + hit] = True
    return found


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors held in integers, after equal ends are cut off."""
    if a == b:
        return 0
    k, least = 0, min(len(a), len(b))
    while k < least and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    k, least = 0, min(len(a), len(b))
    while k < least and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    up, down, score = full, 0, len(b)
    for c in a:
        eq = places.get(c, 0)
        flat = eq | down
        diag = (((eq & up) + up) ^ up) | eq
        rise = down | (full & ~(diag | up))
        fall = up & diag
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = (rise << 1 | 1) & full
        up = (fall << 1 & full) | (full & ~(flat | rise))
        down = rise & flat
    return score


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """1 - distance / longer length >= ``least``, as an exact comparison of the allowed distance.

    Lines of as many words whose differing words add up to no more than that need no distance: it is at most their sum.
    """
    longer = max(len(a), len(b))
    allowed = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > allowed:
        return False
    xs, ys = a.split(" "), b.split(" ")
    if len(xs) == len(ys) and sum([max(len(x), len(y)) for x, y in zip(xs, ys, strict=True) if x != y]) <= allowed:
        return True
    return edit_distance(a, b) <= allowed


def _verified(reach: int, least: float):
    """mapInArrow over shard, fp, stored, rank, line (sorted by shard, stored first): pairs of ranks, a forest in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n, fps, group, lines, ranks = None, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), [], []
        for batch in batches:
            links = []
            for s, fp, stored, rank, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    shard, n, lines, ranks, fps, group = s, 0, [], [], np.zeros(16, np.int64), np.zeros(16, np.int64)
                norm = b" ".join(normalise(line.encode("utf-8", "surrogatepass"))).decode("utf-8", "surrogatepass")
                met = []
                if n:
                    xor = fps[:n] ^ fp
                    near = np.flatnonzero(np.bitwise_count(xor.view(np.uint64)) <= reach)
                    near = near[_first_shared(xor[near], s & 15)] if len(near) else near
                    # One similar line of each group is enough: a tight group of n lines takes n comparisons.
                    for g in np.unique(group[near]).tolist() if len(near) else ():
                        for j in near[group[near] == g].tolist():
                            if similar(norm, lines[j], least):
                                links.append((rank, ranks[j]))
                                met.append(g)
                                break
                if stored:
                    if n == len(fps):
                        fps, group = np.concatenate([fps, np.zeros(n, np.int64)]), np.concatenate([group, np.zeros(n, np.int64)])
                    fps[n], group[n] = fp, n
                    lines.append(norm)
                    ranks.append(rank)
                    n += 1
                    met.append(n - 1)
                if len(met) > 1:
                    group[:n][np.isin(group[:n], met)] = met[-1]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links]), pa.array([y for _, y in links])], names=["a", "b"])

    return run


def _places(document: np.ndarray, line_no: np.ndarray) -> np.ndarray:
    return (document.astype(np.int64).view(np.uint64) ^ mixed(line_no)).view(np.int64)


def _lines_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, rank, line for the places (doc_id, th, line_no) in ``wanted``; texts aren't shuffled, only the lines that a
    sieve of the places lets pass."""

    document = F.xxhash64("doc_id", "th").alias("document")

    def codes(batch: pa.RecordBatch) -> np.ndarray:
        return _places(batch.column(0).to_numpy(), batch.column(1).to_numpy())

    sent = docs.sparkSession.sparkContext.broadcast(sieve(wanted.select(document, "line_no"), codes))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, numbers, held = [], [], []
            documents = batch.column(3).to_numpy()
            for k, text in enumerate(batch.column(2)):
                ls = (text.as_py() or "").split("\n")
                for n in np.flatnonzero(passes(sent.value, _places(documents[k : k + 1], np.arange(len(ls))))).tolist():
                    of.append(k)
                    numbers.append(n)
                    held.append(ls[n])
            if of:
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(held, pa.string())], names=["d", "h", "l", "line"])

    found = docs.select("doc_id", "th", "text", document).mapInArrow(lean(pick), f"d {docs.schema['doc_id'].dataType.simpleString()}, h bigint, l int, line string")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("line_no") == F.col("l"))
    return found.join(wanted, same).select("node", "rank", "line").dropDuplicates(["node"])


def _dead(docs: DataFrame, distinct: DataFrame, path: str, similarity: float, shard_size: int) -> DataFrame:
    """k1, k2 of the distinct lines that are linked to an earlier one."""
    spark = docs.sparkSession
    shards = sharded(distinct.select("node", "fp"), shard_size)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, fp, node in _runs(batches):
            keep = np.flatnonzero(_near(shard, fp, node >= 0))
            if len(keep):
                node = node[keep]
                rows = [shard[keep], fp[keep], node >= 0, np.where(node < 0, -1 - node, node)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["shard", "fp", "stored", "node"])

    dealt = shards.repartition("shard").sortWithinPartitions("shard", "fp")
    dealt.mapInArrow(lean(active), "shard bigint, fp bigint, stored boolean, node bigint").write.parquet(f"{path}/near")
    near = spark.read.parquet(f"{path}/near")

    # Ranks go by the first occurrence, so a group's smallest rank is the line that stays.
    places = distinct.select("node", "k1", "k2", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"), F.col("first.line_no").alias("line_no"))
    wanted = sifted(places, "node", near.select("node")).join(near.select("node").distinct(), "node", "left_semi")
    wanted.orderBy("doc_id", "th", "line_no").withColumn("rank", F.monotonically_increasing_id()).write.parquet(f"{path}/wanted")
    wanted = spark.read.parquet(f"{path}/wanted")
    _lines_of(docs, wanted).write.parquet(f"{path}/texts")
    verify = near.join(spark.read.parquet(f"{path}/texts"), "node").select("shard", "fp", "stored", "rank", "line")
    verify = verify.repartition("shard").sortWithinPartitions("shard", F.desc("stored"), "rank")
    groups = components(verify.mapInArrow(lean(_verified(REACH, similarity)), "a bigint, b bigint"))
    return wanted.join(groups.where("node <> root").select(F.col("node").alias("rank")), "rank", "left_semi").select("k1", "k2")


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shard_size: int = SHARD) -> DataFrame:
    """One row a row of ``docs``: doc_id, th (hash of the text), n_lines (with a word), n_kept, removed (array of line numbers from 0).

    Lines are split at line feeds and normalised (case of A-Z, digits, white space). Two lines are linked if they are equal
    so, or if their SimHashes agree under a mask and differ in at most REACH of 64 bits and 1 less their edit distance
    over the longer length is at least ``similarity``. Of each connected group the first occurrence stays, by doc_id (null
    first), then hash of the text, then line. Rows with equal doc_id and text are one document, so their lines stay or go
    alike. Null and empty texts and lines without a word have nothing to remove; an empty table stays empty. Lines of any
    length are hashed whole, in bounded steps; other columns of ``docs`` take no part, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))
    path = scratch(spark, "lines")
    line_rows(docs).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    lines = rows.where("line_no >= 0").select("k1", "k2", "doc_id", "th", "line_no")
    found = rows.where("line_no >= 0").groupBy("k1", "k2").agg(F.max("fp").alias("fp"), F.min(F.struct("doc_id", "th", "line_no")).alias("first"), F.count("*").alias("n"))
    found.withColumn("node", F.monotonically_increasing_id()).write.parquet(f"{path}/distinct")
    distinct = spark.read.parquet(f"{path}/distinct")
    dead = _dead(docs, distinct, path, similarity, shard_size)

    # What is known of each line that goes somewhere: the place where it stays, if it does, and how often it occurs.
    several = distinct.where("n > 1").select("k1", "k2", "n", F.col("first.doc_id").alias("d"), F.col("first.th").alias("h"), F.col("first.line_no").alias("l"), F.lit(False).alias("dead"))
    known = several.unionByName(dead.withColumn("dead", F.lit(True)), allowMissingColumns=True).groupBy("k1", "k2")
    known = known.agg(F.coalesce(F.max("n"), F.lit(1)).alias("n"), F.any_value("d", F.lit(True)).alias("d"), F.max("h").alias("h"), F.max("l").alias("l"), F.max("dead").alias("dead"))
    known = checkpoint(known)
    # A line that makes up more than 1 in HOT of all rows would go to one task: there are fewer than HOT such, so they are
    # broadcast, and only the others are joined by key.
    often = F.col("n") * HOT > rows.count()
    hot, rest = F.broadcast(known.where(often)), known.where(~often)
    lines = sifted(lines, "k1", known.select("k1"))
    met = lines.join(hot, ["k1", "k2"]).unionByName(lines.join(hot.select("k1", "k2"), ["k1", "k2"], "left_anti").join(rest, ["k1", "k2"]))
    stays = ~F.col("dead") & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("line_no") == F.col("l"))
    gone = met.where(~stays).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    gone = gone.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "removed")
    each = rows.where("line_no < 0").select("doc_id", "th", F.col("k1").alias("n_lines"))
    each = each.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return each.select("doc_id", "th", "n_lines", (F.col("n_lines") - F.size(removed)).cast("long").alias("n_kept"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the lines that duplicates() removes, and without documents that so lose all their words.

    Nulls, empty and long texts, repeated rows and empty tables as duplicates() says; a row that loses no line stays as it is.
    """
    found = duplicates(docs, doc_id, text, similarity).where(F.size("removed") > 0).dropDuplicates(["doc_id", "th"])
    d, h, removed, left = fresh(docs, "_d", "_h", "_removed", "_kept")
    found = found.select(F.col("doc_id").alias(d), F.col("th").alias(h), F.col("removed").alias(removed), F.col("n_kept").alias(left))
    joined = docs.join(found, F.col(doc_id).eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(h)), "left")
    kept = F.transform(F.array(F.split(text, "\n")), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), removed), lambda k: F.get(ls, k)), "\n"))[0]
    joined = joined.where(F.col(removed).isNull() | (F.col(left) > 0))
    return joined.withColumn(text, F.when(F.col(removed).isNotNull(), kept).otherwise(F.col(text))).select(*docs.columns)


def query(spark, sf_dir):
    """op1: doc_id, n_lines, n_kept, removed_lines (numbers from 0, comma-joined) for every document."""
    found = duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_kept", F.array_join(F.transform("removed", lambda k: k.cast("string")), ",").alias("removed_lines"))
