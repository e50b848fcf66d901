from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from corvane.llm import bpe, packing, pii, quality, simhash
from tests.llm.test_groups import brute_lines, groups, slow_fingerprint
from tests.llm.test_packing_pii_warc import brute_terms
from tests.llm.test_quality import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(11)
    common = "the of and to in that is was for with".split()
    vocab = [*("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9))) for _ in range(900))]
    line = lambda n: " ".join(rng.choice(common if rng.random() < 0.3 else vocab) for _ in range(n))
    shared = line(60)
    docs = []
    for k in range(40):
        text = "\n".join(line(rng.randint(12, 40)) for _ in range(rng.randint(2, 6)))
        if k % 5 == 0:
            text += "\n" + shared
        if k % 7 == 0:
            text += f"\nwrite to someone{k % 3}@mail.example or +49 (30) 1234-{k:04d} zanzibar please"
        docs.append((k, text))
    docs += [(100, docs[3][1]), (101, docs[4][1].replace(" the ", " a ", 1)), (102, None), (103, ""), (104, "too short"), (105, "same same same same same same " * 20), (None, line(50)), (106, " | ".join(vocab[20:90])), (107, docs[7][1]), (107, docs[7][1])]
    return [(d, t, "en", "s", None if t is None else len(t)) for d, t in docs]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def key(rows):
    return sorted(((r[0] is None, r[0] or 0, r[1]) for r in rows))


def test_stages_against_brute_force(spark, folder):
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "personal data", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    out = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        out.append(docs)
        if k < 4:
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").count() == 0
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    kept = []
    for d, t, *_ in corpus():
        b = brute(t)
        if not (b["n_words"] < 10 or 100 * b["n_repeat_words"] > 20 * b["n_words"]):
            kept.append((d, t))
    passed = {(r["doc_id"], r["text"]) for r in quality.judge(spark.createDataFrame(kept, "doc_id bigint, text string")).where("quality.kept").collect()}
    want = [x for x in kept if x in passed]
    assert key(pairs(out[0])) == key(want) and len(want) >= 40

    h = {r["text"]: r["h"] for r in spark.createDataFrame(want, "doc_id bigint, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    gone = brute_lines({(d, h[t], t) for d, t in want})
    left = []
    for d, t in want:
        lines = [x for k, x in enumerate(t.split("\n")) if k not in gone.get((-1 if d is None else d, h[t]), [])]
        if any(x.split() for x in lines):
            left.append((d, "\n".join(lines)))
    assert key(pairs(out[1])) == key(left) and len(left) < len(want)

    fps = [slow_fingerprint(t) for _, t in left]
    tops, best = groups(len(left), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2), {}
    for x, t in zip(left, tops, strict=True):
        best[t] = min(best.get(t, x), x, key=lambda y: (y[0] is None, y[0] or 0))
    assert key(pairs(out[2])) == key(best.values())

    ordered = sorted(best.values(), key=lambda y: (y[0] is None, y[0] or 0))
    clean = [(d, pii.redact(t, [*b, *m])) for (d, t), (b, m) in zip(ordered, brute_terms(ordered), strict=True)]
    assert key(pairs(out[3])) == key(clean) and any("[EMAIL]" in t for _, t in clean) and any("[PHONE]" in t for _, t in clean)

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = out[4].collect()
    assert {r["doc_id"]: enc.decode(bpe.unpacked(bytes(r["ids"]), enc.n_vocab)) for r in got} == dict(clean) and all(r["n_tokens"] <= r["bucket_length"] <= packing.MAX_LENGTH for r in got)
    assert {(r["doc_id"], r["n_tokens"], r["bucket_length"]) for r in pipeline.run(spark, folder).collect()} == {(r["doc_id"], r["n_tokens"], r["bucket_length"]) for r in got}


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert simhash.RADIUS == 2
