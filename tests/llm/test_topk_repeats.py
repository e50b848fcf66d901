"""Repeated rows of operator 9 against its own SQL."""

from __future__ import annotations

import random

import duckdb
import pytest

from corvane.llm import topk as T


@pytest.mark.parametrize("query_bytes", [1 << 24, 1])
def test_repeated_rows_agree_with_sql(spark, tmp_path, query_bytes):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(60)]
    rows += rows[:5] + rows[20:30] + rows[50:51] * 2
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/e")
    vectors = T.quantised(spark.read.parquet(f"{tmp_path}/e"))
    got = T.top_k(vectors, vectors.where("vec_id % 50 = 0"), query_bytes=query_bytes).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = con.execute(T.sql()).fetchall()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
