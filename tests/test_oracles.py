"""Every query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _text(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_agrees_with_sql(spark, sf, con, name):
    got = entry.queries()[name](spark, sf)
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted(tuple(_text(r[c]) for c in order) for r in got.collect())
    theirs = sorted(tuple(_text(v) for v in (dict(zip(columns, r, strict=True))[c] for c in order)) for r in want.fetchall())
    assert mine == theirs


def test_every_query_has_sql_or_a_test():
    without = {n for n in entry.queries() if n not in entry.oracle_sql()}
    assert {n for n in without if not n.startswith(("op", "pipeline"))} <= {"hll_daily_users", "rollup_users_hll", "tenant_aggregate_unique_sessions_hll"}


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
