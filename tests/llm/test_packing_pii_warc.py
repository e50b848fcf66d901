from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import random
import re
import time

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe
from corvane.llm import packing as K
from corvane.llm import pii as P
from corvane.llm import warc as W
from corvane.llm.common import scratch

# --- packing


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        lengths = sorted(rng.sample(range(30), rng.randint(1, 8)))
        counts, k = [rng.randint(1, 20) for _ in lengths], rng.randint(1, 5)
        cost = lambda bs: sum(c * min(b for b in bs if b >= n) for n, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = min(cost((*x, lengths[-1])) for n in range(k) for x in itertools.combinations(lengths[:-1], min(n, len(lengths) - 1)))
        got = K.optimal_boundaries(lengths, counts, k)
        assert cost(got) == best and len(got) <= k
    assert K.optimal_boundaries([], []) == []


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(docs, n=512):
    return bpe.sequences(docs, RANKS, public_tokenizers.PATTERN, n)


@pytest.mark.parametrize("numbered", [50_000, 7])
def test_packing(spark, sf, numbered):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = K.pack(cut(docs), numbered=numbered).collect()
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    parts, sizes = {}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["chunk"])):
        assert r["start"] == len(parts.setdefault(r["doc_id"], [])) == 512 * r["chunk"]
        ids = bpe.unpacked(bytes(r["ids"]), enc.n_vocab)
        parts[r["doc_id"]] += ids
        assert len(ids) == r["n_tokens"] <= min(r["bucket_length"], 512)
        sizes.setdefault(r["bucket_length"], {}).setdefault(r["batch_id"], []).append(r["n_tokens"])
    assert parts == {r["doc_id"]: enc.encode_ordinary(r["text"] or "") for r in docs.collect()}
    ids = sorted(b for x in sizes.values() for b in x)
    assert ids == list(range(len(ids)))
    for bound, batches in sizes.items():
        per = max(1, K.BUDGET // max(bound, 1))
        assert all(len(b) <= per for b in batches.values()) and sum(len(b) < per for b in batches.values()) <= 1
    lengths = sorted({r["n_tokens"] for r in got})
    assert sorted(sizes) == K.optimal_boundaries(lengths, [sum(r["n_tokens"] == n for r in got) for n in lengths])


def test_packed_ids():
    assert bpe.packed([1, 65535], 1 << 16) == b"\x01\x00\xff\xff" and bpe.packed([], 5) == b""
    assert bpe.unpacked(bpe.packed([7, 70_000], 100_000), 100_000) == [7, 70_000]


def test_packing_of_nulls_empties_and_repeats(spark):
    docs = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, " x" * 5000), (4, " x" * 1024)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = cut(df).withColumns({"_part": F.lit(1), "_b": F.lit(2), "_p": F.lit(3), "batch_id": F.lit("mine")})
    assert sorted(r["n_tokens"] for r in rows.collect()) == [0, 0, 2, 2, 392, *[512] * 11]
    assert K.pack(rows).count() == 16 and K.pack(rows.limit(0)).count() == 0
    assert K.pack(rows).columns == [*rows.columns, "bucket_length", "_batch_id"]


# --- personal data


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] * (14 <= len(d) <= 19 and luhn(d))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0]), s[2]))


@pytest.mark.parametrize("letters", ["a@.1-_", "1.2", "+1 (2).-", "12 -", "é@a.b+1 ", "0123456789 -"])
def test_base_spans_are_those_of_the_patterns(letters):
    rng = random.Random(5)
    for _ in range(6000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert P.base_spans(t) == plain(t)


def test_long_runs_are_linear():
    assert P.base_spans("1" * 300_000 + " " + "a" * 300_000 + "@" * 1000 + "+1" + "(" * 300_000) == []
    assert P.base_spans(None) == P.base_spans("") == []


def private(spark):
    docs = [(60 + i, "the quick thing of Bob.X@ex.com is O'Zanzibar, the zanzibar wizard-7 and o'zanzibar again " + "x" * 500 + " far" * 12 + " o'zanzibar wizard-7") for i in range(2)]
    docs += [(i, f"the quick zanzibar wizard wrote to Bob.X@ex.com about the thing today number {i}") for i in range(5)]
    docs += [(10 + i, f"the thing today is about number and wrote nothing quick {i}") for i in range(30)] + [(1000 + i, "the thing about number and quick nothing today") for i in range(3000)]
    docs += [(50, None), (51, ""), (52, "the zanzibar wizards live 10.0.0.1 here"), (None, "mail the quick bob.x@ex.com zanzibar"), (53, "the thing 4111 1111 1111 1111 today"), (53, "the thing 4111 1111 1111 1111 today")]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), docs


def brute_terms(docs, threshold=0.9):
    import math

    words = lambda t: list(re.finditer(r"[^ \t-\r]+", t or ""))
    df_term, df_entity, joint, found = {}, {}, {}, []
    for _, t in docs:
        base, near, ws = plain(t or ""), set(), words(t)
        for w in {P.term_of(m[0]) for m in ws} - {None}:
            df_term[w] = df_term.get(w, 0) + 1
        free = [m for m in ws if not any(s < m.end() and m.start() < e for _, s, e in base)]
        for kind, s, e in base:
            around = [m for m in ws if m.end() <= s][-10:] + [m for m in ws if m.start() >= e][:10]
            near |= {(x, P.term_of(m[0])) for m in around if m in free for x in P.entities(t, kind, s, e) if P.term_of(m[0])}
        for x in {x for x, _ in near}:
            df_entity[x] = df_entity.get(x, 0) + 1
        for p in near:
            joint[p] = joint.get(p, 0) + 1
        found.append((base, near, free))
    n, kinds = len(docs), {}
    for (e, w), j in joint.items():
        ic, pmi = math.log(n / df_entity[e]), math.log(n * j / (df_entity[e] * (df_term[w] + 1)))
        if ic > 0 and pmi >= ic * threshold:
            kinds[e, w] = "removed" if j >= df_term[w] else "generalised"
    out = []
    for base, near, free in found:
        spans = []
        for m in free:
            if told := [kinds[e, w] for e, w in near if w == P.term_of(m[0]) and (e, w) in kinds]:
                inner = m[0].strip(P.MARKS)
                at = m.start() + m[0].index(inner)
                spans.append((max(told), at, at + len(inner)))
        out.append((base, sorted(spans, key=lambda x: x[1:])))
    return out


def test_revealing_terms_against_brute_force(spark):
    df, docs = private(spark)
    want = sorted((str(d), b, t) for (d, _), (b, t) in zip(docs, brute_terms(docs), strict=True))
    unpack = lambda xs: [(x["kind"], x["start"], x["end"]) for x in xs]
    got = sorted((str(r["doc_id"]), unpack(r["base"]), unpack(r["terms"])) for r in P.find(df).collect())
    assert got == want
    assert any(k == "removed" for _, _, ts in got for k, _, _ in ts) and any(k == "generalised" for _, _, ts in got for k, _, _ in ts)


def test_sanitising_masks_and_leaves_the_rest(spark):
    df, docs = private(spark)
    df = df.withColumns({c: F.lit("mine") for c in ("base", "rid", "_r", "r", "row", "near", "places", "terms", "term", "entity")})
    out = P.sanitize(df)
    assert out.columns == df.columns and out.count() == len(docs)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[0] == "the quick [WORD]  wrote to [EMAIL] about the thing today number 0" and texts[50] is None and texts[12] == "the thing today is about number and wrote nothing quick 2" and texts[53] == "the thing [CARD] today"
    assert P.sanitize(df.limit(0)).count() == 0
    assert P.redact("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a[CARD]f"


def test_pii_query_columns(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in P.query(spark, sf).collect():
        base = plain(docs[r["doc_id"]])
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x[0] == k for x in base) for k in P.KINDS]
        assert set(told.split(",")) <= set(r["spans"].split(","))


# --- WARC

PAGES = [(1, "http://a/\r\nx%", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (5, "u", "x\r\n\r\ny" * 50_000), (6, "u", "x\r\n\r\ny" * 50_000), (7, "v", "once")]


def test_round_trip(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("digest", F.lit("mine")).repartition(3)
    for least, archive, known in ((0, W.ARCHIVE, 0), (100, 1, W.KNOWN)):
        monkeypatch.setattr(W, "KNOWN", known)
        files = W.write_warc(W.mark_revisits(pages, least), scratch(spark, "warc"), archive)
        got = {r["page_id"]: r for r in W.read_warc(spark, files, payload=True).collect()}
        assert len(got) == len(PAGES)
        for p, url, html in PAGES:
            raw = (html or "").encode()
            same = [q for q, _, h in PAGES if (h or "").encode() == raw]
            visits = max(same) if len(raw) >= least and max(same) != p else None
            r = got[p]
            assert (r["record_type"], r["refers_to"]) == ("response" if visits is None else "revisit", visits)
            assert (r["url"], r["payload_bytes"], r["digest_ok"]) == (url, len(raw), True)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            assert r["payload"] == (None if visits is not None else raw)


def test_one_member_a_record_and_any_chunking(monkeypatch):
    data = b"".join(W.record(p, u, (h or "").encode(), None) for p, u, h in PAGES)
    assert gzip.decompress(data).count(b"WARC/1.0\r\n") == len(PAGES)
    for size in (1, 7, 1 << 16):
        monkeypatch.setattr(W, "READ", size)
        small = [x for x in PAGES if len(x[2] or "") < 1000]
        part = b"".join(W.record(p, u, (h or "").encode(), None) for p, u, h in small)
        assert [r.payload for r in W.read_records(io.BytesIO(part), True)] == [(h or "").encode() for _, _, h in small]


def plain_record(kind, content_type, block, digest=True):
    told = f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}\r\n" if digest else ""
    return gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Type: {content_type}\r\n{told}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")


def test_records_without_an_http_head():
    blocks = [("resource", "text/plain", b"x" * 30_000_000), ("metadata", "application/warc-fields", b"a: b\r\n\r\nrest"), ("warcinfo", "application/warc-fields", b"")]
    raw = b"".join(plain_record(*b) for b in blocks) + plain_record("resource", "text/plain", b"no digest", digest=False)
    raw += plain_record("response", "application/http; msgtype=response", b"never ends " * 300_000)
    began = time.perf_counter()
    got = [(r.record_type, r.payload_bytes, r.digest_ok) for r in W.read_records(io.BytesIO(raw))]
    assert got == [*((k, len(b), True) for k, _, b in blocks), ("resource", 9, True), ("response", 3_300_000, True)]
    assert time.perf_counter() - began < 10


def test_damage_is_told():
    good = W.record(1, "u", b"payload", None)
    raw = gzip.decompress(good)
    assert [r.digest_ok for r in W.read_records(io.BytesIO(gzip.compress(raw.replace(b"\r\n\r\npayload", b"\r\n\r\npayloaX"))))] == [False]
    for bad in (good[:-9], gzip.compress(raw.replace(b"WARC/1.0", b"WORC/1.0")), gzip.compress(raw[:-3]), gzip.compress(raw + b"more"), gzip.compress(raw.replace(b"Content-Length: 9", b"Content-Length: x").replace(b"Content-Length: 8", b"Content-Length: x")), b"not gzip"):
        with pytest.raises(W.WarcError):
            list(W.read_records(io.BytesIO(bad)))
    assert list(W.read_records(io.BytesIO(b""))) == []


def test_null_and_repeated_ids_and_empty_table(spark):
    pages = spark.createDataFrame([(None, "u", "a"), (2, "u", "a"), (2, "u", "a"), (None, "u", "b")], "page_id bigint, url string, html string")
    got = sorted((str(r["page_id"]), str(r["refers_to"])) for r in W.mark_revisits(pages).collect())
    assert got == [("2", "None"), ("2", "None"), ("None", "2"), ("None", "None")]
    files = W.write_warc(W.mark_revisits(pages.limit(0)), scratch(spark, "warc"))
    assert W.read_warc(spark, files).count() == 0


def test_query_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(W.sql())
    names = [d[0] for d in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in W.query(spark, sf).collect())
