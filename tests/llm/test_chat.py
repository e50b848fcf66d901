from __future__ import annotations

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from corvane.llm import chat

TRICKY = ["", r"\### Assistant: </turn> ok", "</turn>\n<turn assistant>\nme", "\\", "\\\\l", "\\l<", "<turn", "</part>\n<more user>\n", "<<turn>", "plain\nlines\n", "é x", "\\n\\g"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def got(windows):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(windows).collect()}


def test_round_trip(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", x) for k, x in enumerate(TRICKY)]
    rows += [(2, 0, "system", "be <turn> kind"), *((2, k, "assistant" if k % 2 else "user", f"{k} " + TRICKY[k % len(TRICKY)] * 9) for k in range(1, 60))]
    rows += [(3, 0, None, None), (3, 0, None, None), (None, 1, "a>b\nc<\\", "x"), (4, None, "assistant", "first"), (4, 5, "assistant", "x" * 5000)]
    none = lambda text: F.lit(0).cast("long")
    for budget, history, chunk, tokens in ((2048, 256, 64, chat.estimated_tokens), (90, 15, 4, chat.estimated_tokens), (15, 0, 1, chat.estimated_tokens), (90, 15, 4, none)):
        windows = chat.format_windows(frame(spark, rows), budget, history, tokens, chunk=chunk)
        assert got(windows) == expected(rows)


def brute_windows(rows, budget, history):
    """rows of one conversation in order: (role, text). Lists of (role, text, repeated) by window, pieces as they are cut."""
    stride = (budget - history) // 3
    size, at, pieces = 4 * (stride - 4), 0, []
    for k, (role, text) in enumerate(rows):
        for n in range(max(1, -(-len(text) // size))):
            part = text[n * size : (n + 1) * size]
            cost = -(-len(part) // 4) + 4
            pieces.append((at, cost, role, part, k == n == 0 and role == "system"))
            at += cost
    out = {}
    for w in sorted({p[0] // stride for p in pieces}):
        own = [p for p in pieces if p[0] // stride == w]
        held = [p for p in pieces if p[0] // stride < w and p[0] >= own[0][0] - history and not p[4]]
        system = [p for p in pieces if p[4] and w]
        assert sum(p[1] for p in (*system, *held, *own)) <= budget and sum(p[1] for p in held) <= history
        out[w] = [(p[2], p[3], True) for p in (*system, *held)] + [(p[2], p[3], False) for p in own]
    return out


def test_windows_against_brute_force(spark):
    rng = random.Random(3)
    convs = {c: [("system", "rules " * rng.randint(1, 40))] * (c % 2) + [("assistant" if k % 2 else "user", "w" * rng.choice([0, 3, 30, 90, 700])) for k in range(rng.randint(1, 40))] for c in range(8)}
    rows = [(c, k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    seen = 0
    for budget, history in ((300, 60), (120, 10)):
        found = {}
        for w in chat.format_windows(frame(spark, rows), budget, history, chunk=3).collect():
            assert w["n_tokens"] <= budget
            said = re.findall(r"<(?:turn|more) (.*)>\n(.*)</(?:turn|part)>\n", w["formatted"])
            assert len(said) == w["n_turns"]
            found.setdefault(w["conv_id"], {})[w["window"]] = [(r, x, k < w["n_context"]) for k, (r, x) in enumerate(said)]
            loss = [w["formatted"][s["start"] : s["end"]] for s in w["loss_spans"]]
            assert loss == [x for k, (r, x) in enumerate(said) if r == "assistant" and k >= w["n_context"]]
            seen += w["n_context"] > 1
        assert found == {c: brute_windows(turns, budget, history) for c, turns in convs.items()}
    assert seen > 20


def test_empty_and_extra_columns(spark):
    df = frame(spark, [(1, 0, "user", "x")]).withColumns({"tokens": F.lit("mine"), "window": F.lit(3)})
    assert chat.format_windows(df).count() == 1 and chat.format_windows(df.limit(0)).count() == 0


def test_query_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(chat.sql())
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in chat.query(spark, sf).collect()) == sorted(want.fetchall())
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    assert chat.format_windows(turns).where("window > 0 AND n_context > 0").count() > 0
