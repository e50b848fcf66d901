from __future__ import annotations

import random

from corvane.functions.columns import deterministic_id  # noqa: F401
from corvane.operators import identity


def fold(rows):
    """The rule itself, one event after the other."""
    a, u, out, merges = {}, {}, [], []
    for seq, tenant, anon, user in rows:
        new = f"{tenant}|{seq}"
        ka, ku = (tenant, anon), (tenant, user)
        if user:
            if ka in a and ku in u and a[ka] != u[ku]:
                merges.append((seq, a[ka], u[ku]))
                a[ka] = u[ku]
            elif ka in a and ku not in u:
                u[ku] = a[ka]
            elif ka not in a and ku in u:
                a[ka] = u[ku]
            elif ka not in a:
                a[ka] = u[ku] = new
        else:
            a.setdefault(ka, new)
        out.append((seq, a[ka]))
    return out, merges


def run(spark, rows):
    data = [(str(s), t, a, u, "2024-01-01 00:00:00.000", s) for s, t, a, u in rows]
    df = spark.createDataFrame(data, "event_id string, tenant_id string, anonymous_id string, user_id string, event_time string, seq bigint")
    got = sorted((r["seq"], r["tenant_id"], r["canonical_id"], r["merge_old"]) for r in identity.resolve(df).collect())
    return got


def same(got, rows):
    """Equal up to one-to-one renaming of ids."""
    want, merges = fold(rows)
    name = {}
    for (seq, _, canon, _), (s, c) in zip(got, want, strict=True):
        assert seq == s
        assert name.setdefault(canon, c) == c
    assert len(set(name.values())) == len(name)
    assert [(seq, name[old], name[canon]) for seq, _, canon, old in got if old is not None] == merges


def test_written_out_case(spark):
    a, b = "tenant-a", "tenant-b"
    rows = [(1, a, "device-a", None), (2, a, "device-a", ""), (3, a, "device-a", "alice"), (4, a, "device-b", None), (5, a, "device-b", "alice"), (6, a, "device-b", None), (7, a, "device-c", "alice"), (8, b, "device-a", "alice"), (9, b, "device-b", None), (10, a, "device-d", "bob"), (11, a, "device-b", ""), (12, b, "device-b", "alice"), (13, a, "device-e", "alice")]
    got = run(spark, rows)
    same(got, rows)
    alias = {}
    told = []
    for _, tenant, canon, _ in got:
        names = alias.setdefault(tenant, {})
        told.append(names.setdefault(canon, f"c{len(names) + 1}"))
    assert told == ["c1", "c1", "c1", "c2", "c1", "c1", "c1", "c1", "c2", "c3", "c1", "c1", "c1"]
    assert [r[0] for r in got if r[3]] == [5, 12]


def test_random_sequences_equal_the_fold(spark):
    rng = random.Random(7)
    rows = []
    for seq in range(3000):
        tenant = f"t{rng.randrange(60)}"
        rows.append((seq, tenant, f"a{rng.randrange(5)}", rng.choice([None, "", *(f"u{k}" for k in range(6))])))
    same(run(spark, rows), rows)


def test_empty(spark):
    assert run(spark, []) == []
