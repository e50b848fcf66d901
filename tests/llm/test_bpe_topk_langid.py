from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, langid, topk

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "it's we're 12345  x\n\n y", "<|endoftext|>", "naïve 😀 日本語 テスト", "a" * 3000, "word 12 " * 3000, "\x00\x1c x", "é́   z"]


def test_ids_and_bytes_are_tiktokens(spark):
    enc = bpe.encoding(RANKS, P.PATTERN)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    digests = {r["doc_id"]: r for r in bpe.digest_column(df, RANKS, P.PATTERN).collect()}
    ids = {r["doc_id"]: (r["ids"], bytes(r["decoded"])) for r in bpe.decode_column(bpe.encode_column(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    for k, text in enumerate(TEXTS):
        want = enc.encode_ordinary(text or "")
        raw = (text or "").encode()
        assert ids[k] == (want, raw)
        r = digests[k]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())


def test_pieces_split_only_where_tokens_do(monkeypatch):
    rng = random.Random(3)
    enc = bpe.encoding(RANKS, P.PATTERN)
    monkeypatch.setattr(bpe, "_LONG", bpe.regex.compile(rf"[{bpe._SPACE}]{{3,}}+"))
    for _ in range(1500):
        text = "".join(rng.choice(list("ab1    \n\t'sté.!  日\u3000\x85\x1c")) for _ in range(rng.randrange(120)))
        assert "".join(p for p, _ in bpe.pieces(text, 7)) == text
        assert [i for ids in bpe.encode(enc, text) for i in ids] == enc.encode_ordinary(text)


@pytest.mark.parametrize("n", [5000, 1_000_000])
def test_long_runs(spark, n):
    enc = bpe.encoding(RANKS, P.PATTERN)
    runs = [" " * n, "\n" * n, " \n\t\u3000" * (n // 4), "x" + " " * n + "y", " " * n + "\nz" + "\n" * n, "^" * n, "é" * (n // 2)]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id bigint, text string")
    for r in bpe.digest_column(docs, RANKS, P.PATTERN).collect():
        text = runs[r["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        if n < 10_000:
            want = enc.encode_ordinary(text)
            assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([("mine", "x")], "n_tokens string, text string")
    assert bpe.digest_column(df, RANKS, P.PATTERN).columns[:2] == ["n_tokens", "text"]
    assert bpe.digest_column(df.limit(0), RANKS, P.PATTERN).count() == 0


# --- top k


def brute(vectors, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 3, 4])
def test_top_k_is_exact(spark, slices):
    rng = np.random.default_rng(1)
    vectors = [(int(i), [int(x) for x in rng.integers(-5, 6, 8)]) for i in range(300)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(40)] + [(2000, [0] * 8), (2001, [3, 1]), (2002, [1, 1]), (2003, [])]
    df = spark.createDataFrame(vectors, "vec_id bigint, v array<bigint>").repartition(5)
    queries = [x for x in vectors if x[0] % 50 == 0 or x[0] > 2000]
    q = spark.createDataFrame(queries, "vec_id bigint, v array<bigint>")
    want = brute(vectors, queries, 5)
    for size in (1 << 24, 200):
        got = sorted(tuple(r) for r in topk.top_k(df, q, 5, slices, query_bytes=size, block=32).collect())
        assert got == want


def test_large_integers_and_bad_vectors(spark):
    big = 1 << 28
    df = spark.createDataFrame([(1, [big, big, -1]), (2, [big, big, 1]), (3, [big, -big, 7])], "vec_id bigint, v array<bigint>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df, df.where("vec_id = 1"), 5).collect()}
    assert got == {(1, 2): 2 * big * big - 1, (1, 3): -7}
    raw = spark.createDataFrame([(1, [0.5, -0.001]), (2, None), (3, [None, 1.0]), (4, [float("nan")]), (5, [float("inf")]), (None, [1.0])], "vec_id bigint, embedding array<float>")
    assert [(r["vec_id"], r["v"]) for r in topk.quantised(raw).collect()] == [(1, [128, -1])]
    assert topk.top_k(df, df.limit(0)).count() == 0 and topk.top_k(df.limit(0), df).count() == 0


# --- languages


def test_grams_by_chunks_are_grams_of_the_whole(monkeypatch):
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("abÉñ  ,.1\nZ") for _ in range(rng.randrange(60)))
        whole = [x.tolist() for x in langid._grams(text)]
        for size in (1, 2, 5, 16):
            monkeypatch.setattr(langid, "CHUNK", size)
            assert [x.tolist() for x in langid._grams(text)] == whole
        monkeypatch.undo()


def test_held_out_accuracy_and_fold(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_texts_without_letters_and_without_profiles(spark):
    df = spark.createDataFrame([(1, "the house is on the hill", "en"), (2, "das haus ist auf dem berg", "de"), (3, None, "en"), (4, "12 !", "de"), (5, "x", None)], "doc_id bigint, text string, lang string")
    profiles = langid.learn(df)
    assert list(profiles) == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, profiles).collect()}
    assert got[1] == "en" and got[2] == "de" and got[3] == got[4] == "und" and got[5] in profiles
    assert {r["lang_pred"] for r in langid.predict(df, langid.learn(df.limit(0))).collect()} == {"und"}


def spelled(text):
    """Each n-gram of 1 to 3 letters, words set apart by one gap: the plain way."""
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    words = " " + " ".join(letters.split()) + " "
    found = {}
    for n in (1, 2, 3):
        for k in range(len(words) - n + 1):
            g = words[k : k + n]
            if g.strip():
                found[g] = found.get(g, 0) + 1
    code = lambda g: sum((0 if c == " " else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    sums = {}
    for g, n in found.items():
        sums[code(g)] = sums.get(code(g), 0) + n
    return sums


def test_languages_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:120]
    docs += [(9001, None, "en"), (9002, "", None), (9003, "12 34 !", "de"), (None, "der die das", "de"), (9004, "the of and", None)]
    ranked = lambda sums: sorted(sums, key=lambda g: (-sums[g], g))[: langid.TOP]
    sums = {}
    for d, t, lang in docs:
        if t is not None and lang is not None and zlib.crc32(str(d).encode()) % 3 != 1 or d is None:
            for g, n in spelled(t).items():
                sums.setdefault(lang, {})[g] = sums.get(lang, {}).get(g, 0) + n
    profiles = {lang: ranked(sums[lang]) for lang in sorted(sums)}
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumns({"score": F.lit("mine")})
    got = langid.learn(df.where(langid.fold(F.col("doc_id")) != 1))
    assert got == profiles
    for r in langid.predict(df, got).collect():
        own = ranked(spelled(r["text"] or ""))
        if not own:
            assert (r["lang_pred"], r["_score"]) == ("und", 0.0)
            continue
        off = {lang: sum(min(abs(p.index(g) - k), langid.TOP) if g in p else langid.TOP for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(off), key=off.get)
        assert r["lang_pred"] == best and abs(r["_score"] - (1 - off[best] / (langid.TOP * len(own)))) < 1e-12
