"""Near duplicates and line deduplication against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import common as C
from corvane.llm import lines as L
from corvane.llm import simhash as S
from corvane.llm.components import components


def groups(n, linked):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                up[top(i)] = top(j)
    return [top(i) for i in range(n)]


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


@pytest.mark.parametrize("small", [200_000, 0])
def test_components(spark, small):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int"), small=small).collect()}
    nodes = sorted({x for a, b in edges if a is not None and a != b for x in (a, b)})
    pairs = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    tops = groups(len(nodes), lambda i, j: (nodes[i], nodes[j]) in pairs)
    least = {}
    for n, t in zip(nodes, tops, strict=True):
        least[t] = min(least.get(t, n), n)
    assert got == {n: least[t] for n, t in zip(nodes, tops, strict=True)}
    assert components(spark.createDataFrame([], "a int, b int"), small=small).count() == 0


# --- SimHash


def slow_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(S, "COUNTED", 4)
    for text in [None, "", "A", "a B", "a b c", "x y z\x0bw É é", "to be or not to be to be or not", "q " * 40]:
        assert S.fingerprint(text) == slow_fingerprint(text)
    # Spark's own hash is the same function.
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == signed(xxhash.xxh64_intdigest("a b c", 42))


def test_bk_tree():
    rng = random.Random(5)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = S.BKTree()
    assert list(tree.within(3, 2)) == []
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 97):
        for r in (0, 1, 2, 3):
            assert sorted(tree.within(q, r)) == sorted({v for v in values if (v ^ q).bit_count() <= r})


@pytest.mark.parametrize("size", [4096, 3, 1])
def test_links_lose_nothing(spark, size):
    rng = random.Random(3)
    values = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(20):
            v = base
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    tops = groups(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 2)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    root = {r["node"]: r["root"] for r in components(S.links(df, 2, size)).collect()}
    mine = [root.get(signed(v), signed(v)) for v in values]
    assert len(set(zip(mine, tops, strict=True))) == len(set(mine)) == len(set(tops))


def test_near_duplicates_with_nulls_copies_and_empties(spark):
    text = " ".join(f"word{k}" for k in range(400))
    docs = [(5, text), (3, text + " more"), (9, text), (9, text), (None, text), (7, None), (2, ""), (8, " \n"), (None, "alone here now"), (1, "something else entirely different")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"fp": F.lit("mine"), "least": F.lit(1)})
    got = S.near_duplicates(df).collect()
    assert len(got) == len(docs)
    fps = [slow_fingerprint(t) for _, t in docs]
    tops = groups(len(docs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    want = sorted((str(d), f"{f:016x}", str(min((x for (x, _), u in zip(docs, tops, strict=True) if u == t and x is not None), default=None))) for (d, _), f, t in zip(docs, fps, tops, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    kept = S.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(tops))
    assert S.near_duplicates(df.limit(0)).count() == 0 and S.keep_one(df.limit(0)).count() == 0


# --- lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_fp(ws):
    h = [int.from_bytes(xxhash.xxh64_digest(w, 42), "big") for w in set(ws)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def candidates(f, g):
    return (f ^ g).bit_count() <= 8 and any((f ^ g) & m == 0 for m in L.masks())


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in "xy")
        assert L.edit_distance(a, b) == levenshtein(a, b)
    for _ in range(3000):
        a = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 6)))
        b = "".join(c if rng.random() < 0.9 else rng.choice("abc") for c in a)
        for y in (b, a + "ab", b[2:]):
            assert L.similar(a, y) == (levenshtein(a, y) <= int(0.2 * max(len(a), len(y)) + 1e-9))


def test_line_fingerprints():
    rng = random.Random(8)
    hasher = L._Hasher()
    lines = [[rng.choice([b"a", b"bb", b"ccc", b"|", b"e9"]) for _ in range(rng.randint(1, 20))] for _ in range(300)]
    at = [hasher.add(w) for w in lines]
    _, fps = hasher.done()
    for i, w in zip(at, lines, strict=True):
        assert int(fps[i]) == signed(line_fp(w)) == signed(L._long_line(list(dict.fromkeys(w))))
    counts = [n for n in (1, 2, 254, 255)]
    ws = [[b"w%d" % k for k in range(n)] for n in counts]
    assert L.line_hashes(counts, b"".join(xxhash.xxh64_digest(w, 42) for x in ws for w in x)).tolist() == [line_fp(x) for x in ws]


def test_masks_miss_no_pair():
    rng = random.Random(6)
    assert len(L.masks()) == 10
    for _ in range(2000):
        x = 0
        for _ in range(3):
            x |= 1 << rng.randrange(64)
        assert any(x & m == 0 for m in L.masks())


@pytest.mark.parametrize("wide", [512, 4])
def test_near_finds_every_candidate(wide):
    rng = np.random.default_rng(2)
    n = 300
    shard = np.sort(rng.integers(0, 5, n))
    stored = rng.random(n) < 0.7
    base = rng.integers(-(1 << 62), 1 << 62, 30)
    fp = base[rng.integers(0, 30, n)] ^ (np.int64(1) << rng.integers(0, 63, n)) ^ (np.int64(1) << rng.integers(0, 63, n)) ^ np.where(rng.random(n) < 0.5, np.int64(-(1 << 63)), np.int64(0))

    def meet(i, j):
        x = (int(fp[i]) ^ int(fp[j])) & (2**64 - 1)
        return i != j and shard[i] == shard[j] and (stored[i] or stored[j]) and x.bit_count() <= 3 and [x & m for m in L.masks()].index(0) == shard[i]

    assert L._near(shard, fp, stored, 3, wide).tolist() == [any(meet(i, j) for j in range(n)) for i in range(n)]


def fixture():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 30))] for _ in range(30)]

    def variant(b):
        b = list(b)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(b))
            b[k] = b[k] + rng.choice("xyz1") if rng.random() < 0.7 else rng.choice(vocab)
        if rng.random() < 0.2:
            b[0] = b[0].upper()
        return ("  " if rng.random() < 0.1 else " ").join(b)

    docs = [(i, "\n".join(variant(rng.choice(base)) if rng.random() < 0.9 else "" for _ in range(rng.randrange(7)))) for i in range(120)]
    docs += [(200, None), (None, variant(base[0])), (3, None), (201, ""), (202, " \n\t"), docs[5]]
    return docs


def brute_lines(rows):
    """rows: (doc_id, hash, text), distinct."""
    occ = []
    for d, h, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if ws := L.normalise(line.encode()):
                occ.append((-1 if d is None else d, h, k, b" ".join(ws).decode(), line_fp(ws)))

    def linked(i, j):
        a, b = occ[i], occ[j]
        return a[3] == b[3] or candidates(a[4], b[4]) and levenshtein(a[3], b[3]) <= 0.2 * max(len(a[3]), len(b[3])) + 1e-9

    tops, first = groups(len(occ), linked), {}
    for o, t in zip(occ, tops, strict=True):
        first[t] = min(first.get(t, o[:3]), o[:3])
    out = {}
    for o, t in zip(occ, tops, strict=True):
        out.setdefault(o[:2], [])
        if first[t] != o[:3]:
            out[o[:2]].append(o[2])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("shard", [20_000, 5])
def test_lines_against_brute_force(spark, shard):
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"key": F.lit("mine"), "th": F.lit(0)})
    want = brute_lines([(r["doc_id"], r["h"], r["text"]) for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).distinct().collect()])
    assert sum(map(len, want.values())) > 100
    got = L.duplicates(df, shard_size=shard).collect()
    assert len(got) == len(docs)
    for r in got:
        assert list(r["removed"]) == want.get((-1 if r["doc_id"] is None else r["doc_id"], r["th"]), [])
    left = {(r["doc_id"], r["text"]) for r in L.dedup_lines(df).collect()}
    h = {t: x for t, x in ((r["text"], r["h"]) for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect())}
    expect = set()
    for d, text in docs:
        gone = want.get((-1 if d is None else d, h[text]), [])
        kept = [x for k, x in enumerate((text or "").split("\n")) if k not in gone]
        if not gone:
            expect.add((d, text))
        elif any(x.split() for x in kept):
            expect.add((d, "\n".join(kept)))
    assert left == expect


def test_no_lines(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert L.duplicates(df).count() == 0 and L.dedup_lines(df).columns == df.columns


def test_a_sieve_holds_no_match_back(spark):
    rng = np.random.default_rng(4)
    codes = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    table = C.sieve(spark.createDataFrame([(int(c),) for c in codes[:2000]], "c bigint").repartition(3))
    assert C.passes(table, codes[:2000]).all() and C.passes(table, codes[2000:]).mean() < 0.01
    may = C.holder(table)
    assert [may(int(c)) for c in codes] == C.passes(table, codes).tolist()
    assert not C.sieve(spark.createDataFrame([], "c bigint")).any()
