"""Clustering with bounds against plain rounds of full scans in integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from marlspar.llm import clusters


def brute(rows, k, rounds, n=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in first[:k]]
    if not cents:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [near(v) for _, v in kept]
    total = sum(d for d, _ in found)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, sum(e for e, x in found if x == j), total, sha[j]) for (i, _), (d, j) in zip(kept, found, strict=True)), key=str)


def vectors():
    r = random.Random(3)
    hubs = [[r.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(k, [x + r.gauss(0, 0.2) for x in r.choice(hubs)]) for k in range(400)]
    rows += [(1000 + k, [float(k % 2)] * 64) for k in range(40)]  # many equal vectors, ties
    odd = [0.5] * 64
    return rows + [(2000, None), (2001, odd[:63]), (2002, [*odd, 1.0]), (2003, [*odd[:63], None]), (2004, [*odd[:63], math.nan]), (2005, [*odd[:63], -math.inf]), (2006, []), (None, odd), (7, odd), (7, odd), (2007, [-1000.0] * 64)]


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (4, 6), (1, 2)])
def test_clusters_against_full_scans(spark, k, rounds):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cluster", "2 as q", "3 as upper", "'x' as distance")
    narrow = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted((tuple(r) for r in clusters.cluster(df, k=k, rounds=rounds).collect()), key=str)
    assert got == brute(narrow, k, rounds)


def test_few_vectors_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>"
    rows = [(1, [0.25] * 64), (2, [0.75] * 64), (2, [0.75] * 64)]
    assert sorted(tuple(r) for r in clusters.cluster(spark.createDataFrame(rows, kind)).collect()) == brute(rows, 16, 3)
    assert clusters.cluster(spark.createDataFrame([], kind)).collect() == []
    assert clusters.cluster(spark.createDataFrame([(1, None), (2, [1.0])], kind)).collect() == []
    with pytest.raises(Exception, match="a component is beyond"):
        clusters.cluster(spark.createDataFrame([(1, [1e30] * 64)], kind)).collect()


def test_bounds_skip_scans_and_never_change_the_result():
    r = np.random.default_rng(5)
    q = np.concatenate([r.normal(c * 40, 6, (300, 8)) for c in range(6)]).astype(np.int64)
    cents = q[[0, 300, 600, 900, 1200, 1500]].copy()
    cluster, upper, lower = np.zeros(len(q), np.int32), np.full(len(q), np.inf), np.zeros(len(q))
    scans = []
    for _ in range(5):
        scans.append(clusters.bounded(q, cluster, upper, lower, cents, clusters.separation(cents)))
        best, near, second = clusters.scan(q, cents)
        assert (cluster == best).all()
        assert (upper.astype(float) ** 2 >= near * (1 - 1e-15)).all() and (lower**2 <= second * (1 + 1e-15)).all()
        after = np.array([q[cluster == j].sum(0) // max(1, (cluster == j).sum()) for j in range(6)])
        drift = clusters.up(np.sqrt(clusters.squared(after, cents).astype(float)))
        upper = clusters.up(upper + drift[cluster])
        lower = clusters.down(lower - np.array([np.delete(drift, j).max() for j in range(6)])[cluster])
        cents = after
    assert scans[0] >= 1500 and scans[-1] < len(q) // 10
