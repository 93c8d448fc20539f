"""Exact k-means on integer vectors, screened in float32.

Components are integers, floor(1024 x). The product of a batch with all centroids in float32
gives each distance up to a bound on its rounding error; centroids whose interval overlaps
that of the nearest are shortlisted, and only rows with more than one on the list are
recomputed in integers. So each assignment is the exact one, ties going to the smaller number.
Sums are exact, too; a round is one scan of the kept vectors, and what leaves a task is a sum
for each centroid and component.

The bound: a float32 dot product of m terms with rounded inputs, summed in any order, differs
from the true one by at most g |v| |c|, g = (m + 2) u / (1 - (m + 2) u), u = 2^-24 (Higham,
Accuracy and Stability of Numerical Algorithms, section 3). Norms are rounded upwards. Where a
bound is not finite (components beyond float32), every centroid stays on the list.

Defined results: vectors that are null, of another length or hold null or non-finite
components take no part; fewer vectors than centroids give fewer centroids; repeated rows are
points of their own; a null id starts no centroid, and without any centroid there are no rows; distances and sums beyond 64 bits are null,
while assignments and centroids stay exact. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize, tidy

DIMENSION, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Integers up to this size give distances that int64 holds, and sums of 2^36 rows.
SAFE = 1 << 27
#: Rows that are screened at a time.
BLOCK = 8192
#: Sums beyond a decimal column travel in limbs of this base.
LIMB = 10**24


def kept(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and x (array of doubles) of the rows that take part."""
    x = F.col(f"`{vector}`")
    largest = F.lit(float("inf"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < largest))
    return rows.where(x.isNotNull() & (F.size(x) == DIMENSION)).where(good).select(F.col(f"`{key}`").alias("vec_id"), x.cast("array<double>").alias("x"))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x) of doubles: int64 where SAFE, else Python's integers."""
    with np.errstate(over="ignore"):
        whole = np.floor(x * SCALE)  # a power of two: exact
    if not len(whole) or np.abs(whole).max() <= SAFE:
        return whole.astype(np.int64)
    return np.array([[math.floor(Fraction(v) * SCALE) for v in row] for row in x.tolist()], object)


def _safe(a: np.ndarray) -> bool:
    return a.dtype != object and (not a.size or int(np.abs(a).max()) <= SAFE)


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v to those of c, row by row."""
    if not (_safe(v) and _safe(c)):
        v, c = v.astype(object), c.astype(object)
    d = v - c
    return (d * d).sum(axis=1)


def nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row of v, exactly; ties to the smaller."""
    best, k = np.zeros(len(v), np.int64), len(centroids)
    if k < 2:
        return best
    m = v.shape[1] + 2
    u = 2.0**-24
    g = m * u / (1 - m * u)
    c64 = centroids.astype(np.float64)
    with np.errstate(all="ignore"):
        c32, own = c64.astype(np.float32), (c64 * c64).sum(axis=1)
        reach = np.sqrt(own) * (1 + 1e-12)
        for at in range(0, len(v), BLOCK):
            part = v[at : at + BLOCK]
            p64 = part.astype(np.float64)
            dot = (p64.astype(np.float32) @ c32.T).astype(np.float64)
            norm = np.sqrt((p64 * p64).sum(axis=1)) * (1 + 1e-12)
            # the distance less the row's own square; doubles add an error of their own
            middle = own - 2 * dot
            error = 2 * g * norm[:, None] * reach * (1 + 1e-9) + 1e-13 * (own + 2 * np.abs(dot)) + 1e-6
            high = (middle + error).min(axis=1)
            listed = ~(middle - error > high[:, None])  # not-a-number stays on the list
            found = np.where(listed, 0.0, 1.0).argmin(axis=1)
            for i in np.flatnonzero(listed.sum(axis=1) > 1).tolist():
                on = np.flatnonzero(listed[i])
                exact = distances(np.repeat(part[i : i + 1], len(on), axis=0), centroids[on])
                found[i] = on[min(range(len(on)), key=lambda j: (exact[j], on[j]))]
            best[at : at + len(part)] = found
    return best


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), DIMENSION)


def _limbs(value: int) -> Iterator[tuple[int, Decimal]]:
    sign, rest, i = (-1 if value < 0 else 1), abs(value), 0
    while rest or not i:
        rest, digit = divmod(rest, LIMB)
        yield i, Decimal(sign * digit)
        i += 1


def totals(points: DataFrame, centroids: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """How many points are nearest to each centroid, and their exact sums."""
    sent = points.sparkSession.sparkContext.broadcast(centroids)
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list = [[0] * DIMENSION for _ in range(k)]
        counts = [0] * k
        for batch in batches:
            v = integers(_matrix(batch.column("x")))
            near = nearest(v, sent.value)
            for j in np.unique(near).tolist():
                mine = v[near == j]
                counts[j] += len(mine)
                sums[j] = [a + int(b) for a, b in zip(sums[j], mine.sum(axis=0), strict=True)]
        rows = [(j, d, i, x) for j in range(k) if counts[j] for d, s in enumerate([*sums[j], counts[j]]) for i, x in _limbs(s)]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.decimal128(38, 0)),
        ], ["cluster", "part", "limb", "x"])

    parts = points.select("x").mapInArrow(tidy(run), "cluster int, part int, limb int, x decimal(38,0)")
    counts, sums = [0] * k, [[0] * DIMENSION for _ in range(k)]
    for r in parts.groupBy("cluster", "part", "limb").agg(F.sum("x").alias("x")).collect():
        value = int(r["x"]) * LIMB ** r["limb"]
        if r["part"] == DIMENSION:
            counts[r["cluster"]] += value
        else:
            sums[r["cluster"]][r["part"]] += value
    return counts, sums


def _array(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(x) <= SAFE for r in rows for x in r)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), DIMENSION)


def starts(points: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose ids have the smallest digests, in the order of these."""
    digest = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    rows = points.where("vec_id is not null").select(digest.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    return _array([[int(v) for v in integers(np.array([r["x"]], np.float64))[0]] for r in rows])


def fit(points: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after the rounds; one without points stays where it was."""
    centroids = starts(points, clusters)
    for _ in range(rounds if len(centroids) else 0):
        counts, sums = totals(points, centroids)
        centroids = _array([[s // n for s in sums[j]] if (n := counts[j]) else [int(c) for c in centroids[j]] for j in range(len(centroids))])
    return centroids


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared; null beyond 64 bits) for each point."""
    sent = points.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = integers(_matrix(batch.column("x")))
            near = nearest(v, sent.value)
            far = [int(d) for d in distances(v, sent.value[near])]
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), pa.array(near, pa.int32()), pa.array([d if d < 1 << 63 else None for d in far], pa.int64()),
            ], ["vec_id", "cluster", "distance"])

    return points.mapInArrow(tidy(run), f"vec_id {points.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept row."""
    spark = rows.sparkSession
    bound_batches(spark)
    points = materialize(kept(rows), "centroid-points")
    centroids = fit(points, clusters, rounds)
    # without a centroid there is nothing to be assigned to
    near = materialize(assign(points if len(centroids) else points.where("false"), centroids), "centroid-nearest")
    discard(points)
    exact = "decimal(38,0)"
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast(exact)))
    by = near.groupBy("cluster").agg(whole.alias("s"), F.count(F.lit(1)).alias("n"))
    found = {r["cluster"]: r["s"] for r in by.collect()}  # a row for each centroid
    fits = lambda s: int(s) if s is not None and s < 1 << 63 else None
    inertia = fits(None if None in found.values() else sum(found.values()))
    table = [
        (j, fits(found[j]), inertia, hashlib.sha256(",".join(str(int(x)) for x in centroids[j]).encode()).hexdigest())
        for j in sorted(found)
    ]
    known = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
