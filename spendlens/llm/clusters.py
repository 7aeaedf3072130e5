"""Centroid clustering (Lloyd's rounds) in exact integers by Shallot search.

A vector carries, from round to round, its centroid and an upper bound of the distance to it, and the second nearest
centroid of its last search and a lower bound of the distance to all others. When centroids move, the bounds widen by
the moves. A vector whose upper bound lies below the lower bound, or below half the way from its centroid to the next
one, keeps its centroid unseen. For the others the two remembered centroids are measured, and the search starts from
the closer one, s: it goes through the centroids in order of their distance to s, and ends at the first that is
farther from s than d(x, s) + d(x, second nearest so far), as none beyond can be nearer; that radius shrinks with each
second nearest found. Bounds are doubles with a margin, and only rule centroids out; those that survive are compared by
squared distances in 64-bit integers, ties to the smaller number, so the result is that of a full search.

A round is one pass without a shuffle of vectors: the tasks write the vectors with their new bounds, and one row of sums
per cluster, which a small aggregate adds up. The driver holds k centroids and their k^2 distances, whatever the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import drop, store

DIMS, K, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Distances of vectors up to this squared length fit in 64 bits.
MOST_SQUARED = 1 << 60
_MARGIN = 1e-12
_STATE = "vec_id long, x array<long>, own int, second int, upper double, lower double, n long"
_NAMES = ["vec_id", "x", "own", "second", "upper", "lower", "n"]


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS,
                    scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors that have ``dims`` components, all finite."""
    whole = F.col("v").isNotNull() & (F.size("v") == dims) & \
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.select(df[vec_id].cast("long").alias("vec_id"), df[vector].cast("array<double>").alias("v")).where(whole) \
        .select("vec_id", F.transform("v", lambda c: F.floor(scale * c)).alias("x"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors of the k smallest sha256 of ``<seed>:<vec_id>``; null ids come last, equal ids by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


class Centroids:
    """Centroids, how far each has moved, and the others of each by distance."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points = points
        k = len(points)
        gaps = np.sqrt(np.stack([squared(points, points[j]) for j in range(k)]))
        np.fill_diagonal(gaps, -1)
        self.order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.order, axis=1) * (1 - _MARGIN)
        self.half = self.gaps[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        self.move = np.zeros(k) if before is None else np.sqrt(squared(points, before)) * (1 + _MARGIN)
        others = np.where(np.eye(k, dtype=bool), 0, self.move[None, :])
        self.other_move = others.max(axis=1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a and b."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, own: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids):
    """own, second, upper, lower after the centroids' last move, and how many distances were measured."""
    own, second = own.copy(), second.copy()
    upper = (upper + c.move[own]) * (1 + _MARGIN)
    moved = c.other_move[own]
    lower = lower - moved - _MARGIN * (np.abs(lower) + moved)
    rest = np.flatnonzero(~(upper < np.maximum(lower, c.half[own])))
    near = squared(x[rest], c.points[own[rest]])
    upper[rest] = np.sqrt(near) * (1 + _MARGIN)
    still = ~(upper[rest] < np.maximum(lower[rest], c.half[own[rest]]))
    measured = len(rest)
    rest, near = rest[still], near[still]
    if not len(rest):
        return own, second, upper, lower, measured
    if len(c.points) == 1:
        lower[rest] = np.inf
        return own, second, upper, lower, measured
    a, b, v = own[rest], second[rest], x[rest]
    far = squared(v, c.points[b])
    measured += len(rest)
    swap = (far < near) | (far == near) & (b < a)
    a, b, near, far = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, far, near), np.where(swap, near, far)
    start, reach = a.copy(), np.sqrt(near)
    live = np.arange(len(rest))
    for t in range(c.order.shape[1]):
        ball = (reach[live] + np.sqrt(far[live])) * (1 + _MARGIN)
        live = live[c.gaps[start[live], t] <= ball]
        if not len(live):
            break
        other = c.order[start[live], t]
        d = squared(v[live], c.points[other])
        measured += len(live)
        first = (d < near[live]) | (d == near[live]) & (other < a[live])
        i = live[first]
        b[i], far[i] = a[i], near[i]
        a[i], near[i] = other[first], d[first]
        then = ~first & ((d < far[live]) | (d == far[live]) & (other < b[live]))
        i = live[then]
        b[i], far[i] = other[then], d[then]
    own[rest], second[rest] = a, b
    upper[rest], lower[rest] = np.sqrt(near) * (1 + _MARGIN), np.sqrt(far) * (1 - _MARGIN)
    return own, second, upper, lower, measured


def _points(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _round(spark: SparkSession, state: DataFrame, centroids: Centroids) -> tuple[DataFrame, str]:
    """The next state, and a row (x: sums, own, n) per task and cluster."""
    k, dims = centroids.points.shape
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sums, rows = shared.value, np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x = _points(batch.column(1), dims)
            if len(x) and (np.square(x.astype(float)).sum(axis=1) > MOST_SQUARED).any():
                raise ValueError("a vector is too long for exact distances in 64 bits")
            own, second, upper, lower, _ = assign(x, *(col.to_numpy() for col in batch.columns[2:6]), c)
            for j in np.unique(own):
                mine = own == j
                sums[j] += x[mine].sum(axis=0)
                rows[j] += mine.sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, (own, second, upper, lower)),
                                              pa.nulls(len(x), pa.int64())], names=_NAMES)
        full = np.flatnonzero(rows)
        none = [pa.nulls(len(full), t) for t in (pa.int64(), pa.int32(), pa.float64(), pa.float64())]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * dims), pa.array(sums[full].ravel()))
        yield pa.RecordBatch.from_arrays([none[0], lists, pa.array(full.astype(np.int32)), *none[1:], pa.array(rows[full])],
                                         names=_NAMES)

    out = store(state.mapInArrow(run, _STATE), "clusters")
    shared.destroy()
    return out


def _means(state: DataFrame, points: np.ndarray) -> np.ndarray:
    """Floors of the exact means of the clusters; an empty cluster keeps its centroid."""
    sums = state.where("n is not null").select("own", "n", F.posexplode("x").alias("i", "s")) \
        .groupBy("own", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    new = points.copy()
    for r in sums.collect():  # k * dims rows at most
        new[r["own"], r["i"]] = int(r["s"]) // r["n"]
    return new


def cluster(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, k: int = K,
            rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 per kept vector.

    Vectors with another number of components, or a null or non-finite one, are left out; so is a null vector. With
    fewer vectors than ``k`` there are as many centroids as vectors; equal vectors can make equal centroids, of which
    the smaller number takes all. Repeated rows and ids stay, one output row each. A vector longer than 2^30 after
    scaling (a million, at the default scale) ends the job with an error, as its distances do not fit in 64 bits.
    Other columns of ``df`` are not read; an empty table gives an empty result.
    """
    spark = df.sparkSession
    vectors, path = store(integer_vectors(df, vec_id, vector, dims, scale), "vectors")
    points = first_centroids(vectors, k, seed)
    if not len(points):
        points = np.zeros((1, dims), dtype=np.int64)
    state = vectors.select("vec_id", "x", F.lit(0).alias("own"), F.lit(min(1, len(points) - 1)).alias("second"),
                           F.lit(float("inf")).alias("upper"), F.lit(float("-inf")).alias("lower"))
    before = None
    for _ in range(rounds):
        state, new_path = _round(spark, state, Centroids(points, before))
        drop(spark, path)
        path, before = new_path, points
        points = _means(state, points)
        state = state.where("n is null").drop("n")
        if (points == before).all():  # the other rounds would change nothing
            break
    return _result(spark, state, Centroids(points, before))


def _result(spark: SparkSession, state: DataFrame, centroids: Centroids) -> DataFrame:
    k, dims = centroids.points.shape
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = _points(batch.column(1), dims)
            own = assign(x, *(col.to_numpy() for col in batch.columns[2:6]), c)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)),
                                              pa.array(squared(x, c.points[own]))], names=["vec_id", "cluster", "distance"])

    rows = store(state.mapInArrow(run, "vec_id long, cluster int, distance long"), "clustered")[0]
    shared.destroy()
    digests = [(j, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for j, p in enumerate(centroids.points.tolist())]
    exact = F.col("distance").cast("decimal(38,0)")
    of_cluster = rows.groupBy("cluster").agg(F.sum(exact).alias("s"))
    per = {r["cluster"]: int(r["s"]) for r in of_cluster.collect()}  # k rows at most
    facts = spark.createDataFrame([(j, per[j], sum(per.values()), h) for j, h in digests if j in per],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster") \
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
