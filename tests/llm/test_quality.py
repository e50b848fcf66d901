from __future__ import annotations

import re

import duckdb
import pytest

from corvane.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    ws = WORD.findall(t)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    twice = {g for g in grams if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": dup, "n_repeat_words": len(covered)}


CASES = [None, "", " \n\t", "one", "a b c d e a b c d e", "x " * 40, "a b c d e f\na b c d e f\n\n\n", "été #$ é|é x\u0085y\x0bz\x0cw\rq", "1 2 3 4 5 6 1 2 3 4 5 7 3 4 5 6 1", "the cat sat on the mat and it was happy there all day long"]


def rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r["quality"] for r in Q.judge(df).collect()}


def test_base_statistics(spark):
    got = rows(spark, CASES)
    for k, text in enumerate(CASES):
        want = brute(text)
        assert {c: got[k][c] for c in want} == want, text
        assert got[k]["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])


def test_long_text_and_repeated_rows(spark):
    long = " ".join(f"w{k}" for k in range(120_000)) + " again" * 4
    got = rows(spark, [long, long])
    assert got[0] == got[1] and got[0]["n_words"] == 120_004 and got[0]["n_repeat_words"] == 0 and not got[0]["base_failed"]


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(Q.sql())
    names = [d[0] for d in want.description]
    theirs = sorted(want.fetchall())
    mine = sorted(tuple(r[c] for c in names) for r in Q.query(spark, sf).collect())
    assert mine == theirs


def test_labelled_texts_are_told_apart(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = Q.query(spark, sf).join(labels, "doc_id")
    good = kept.where("quality = 1 AND NOT base_failed")
    assert good.where("kept").count() >= 0.99 * good.count() and kept.where("quality = 0 AND kept").count() <= 0.02 * kept.where("quality = 0").count()


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "short", "mine")], "doc_id bigint, text string, quality string")
    assert Q.quality_filter(df).columns == df.columns and Q.quality_filter(df).count() == 0
    assert Q.quality_filter(df.limit(0)).count() == 0


def test_no_user_functions(spark, sf):
    plan = Q.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


@pytest.mark.parametrize("rule", Q.RULES)
def test_a_rule_without_a_base_passes(spark, rule):
    stats = ", ".join(f"0L AS {c}" for c in Q.STATS)
    assert spark.sql(f"SELECT struct({stats.replace('0L AS ', '0L AS ')}) AS s").select(rule.column(__import__("pyspark").sql.functions.col("s"))).first()[0]
