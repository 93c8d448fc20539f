"""Clusters against plain integer k-means; screening against exact distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from listingloom.llm import centroids

SCHEMA = "vec_id long, embedding array<{}>, cluster int, distance string, x array<int>"


def _brute(rows):
    kept = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None))[:8]
    now = [x for _, x in first]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda x: min(range(len(now)), key=lambda j: (far(x, now[j]), j))
    for _ in range(10):
        at = [near(x) for _, x in kept]
        new = []
        for j, c in enumerate(now):
            mine = [x for (_, x), a in zip(kept, at, strict=True) if a == j]
            new.append([sum(v) // len(mine) for v in zip(*mine, strict=True)] if mine else c)
        now = new
    found = [(i, near(x), far(x, now[near(x)])) for i, x in kept]
    of = {j: sum(d for _, a, d in found if a == j) for j in range(len(now))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, j, d, of[j], sum(of.values()), digest[j]) for i, j, d in found]


def _run(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, x, 7, "clash", [1]) for i, x in rows], SCHEMA.format(kind)).repartition(3)
    return sorted((tuple(r) for r in centroids.cluster(df).collect()), key=str)


def test_against_plain_integers(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(5, 64))
    rows = [(i, (middles[i % 5] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(300)]
    assert _run(spark, rows) == sorted(_brute(rows), key=str)


def test_ties_and_odd_rows(spark):
    r = random.Random(2)
    grid = [(i, [r.choice([-0.5, 0.0, 0.5]) if d < 3 else 0.25 for d in range(64)]) for i in range(200)]  # many equal distances
    odd = [(900, None), (901, [1.0] * 63), (902, [float("nan")] + [0.0] * 63), (903, [float("inf")] * 64), (904, [None] * 64), (None, [0.1] * 64), (905, []), (0, [0.5] * 64), (1, grid[1][1])]
    assert _run(spark, grid + odd) == sorted(_brute(grid + odd), key=str)


def test_few_and_none(spark):
    assert _run(spark, []) == _run(spark, [(None, [0.0] * 64)]) == []
    few = [(1, [0.0] * 64), (2, [1.0] * 64), (1, [0.0] * 64)]
    assert _run(spark, few) == sorted(_brute(few), key=str)


def test_values_beyond_64_bits(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) * (1e30 if i % 3 == 0 else 1e7 if i % 3 == 1 else 1.0) for _ in range(64)]) for i in range(40)]
    got = {r[0]: r for r in _run(spark, rows, "double")}
    for i, j, d, of, total, digest in _brute(rows):
        fits = lambda v: v if v < 1 << 63 else None
        assert got[i][1] == j and got[i][2] == fits(d) and got[i][5] == digest
        assert got[i][3] in (of, None) and got[i][4] is None


@pytest.mark.parametrize("spread", [3, 1000, 1 << 26])
def test_screening_leaves_the_exact_answer(spread):
    rng = np.random.default_rng(spread)
    v, c = rng.integers(-spread, spread, (3000, 64)), rng.integers(-spread, spread, (40, 64))
    c[7] = c[3]  # equal centroids
    c[20] = c[5] + (np.arange(64) == 1)  # a difference that float32 does not see at the largest spread
    v[:40], v[40:80] = c, c
    exact = ((v[:, None, :].astype(object) - c[None]) ** 2).sum(axis=2)
    assert centroids.nearest(v, c).tolist() == [min(range(40), key=lambda j: (row[j], j)) for row in exact]
