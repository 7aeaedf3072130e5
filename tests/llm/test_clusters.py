"""Centroid clustering against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendlens.llm import clusters, queries


def plain(rows, dims, k, rounds, seed=3, scale=1024):
    """(vec_id, cluster, distance, cluster inertia, inertia, centroid hash) of (vec_id, vector) rows."""
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]

    def place(row):
        return (row[0] is None, hashlib.sha256(f"{seed}:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])

    centroids = [v for _, v in sorted(kept, key=place)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = {}
    for _, j, d in found:
        per[j] = per.get(j, 0) + d
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, per[j], sum(per.values()), hashes[j]) for i, j, d in found), key=repr)


def result(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, own int, x string")
    out = clusters.cluster(df.repartition(3), **options)
    return sorted((tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                "centroid_sha256").collect()), key=repr)


def blobs(seed, n, dims, spread=0.2):
    rng = random.Random(seed)
    middles = [[rng.uniform(-2, 2) for _ in range(dims)] for _ in range(6)]
    return [(i * 7 - 50, [c + rng.gauss(0, spread) for c in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("k, rounds", [(8, 10), (20, 6), (1, 3), (2, 0)])
def test_equals_plain_rounds(spark, k, rounds):
    rows = blobs(k, 300, 6, 0.5)
    assert result(spark, rows, dims=6, k=k, rounds=rounds) == plain(rows, 6, k, rounds)


def test_nulls_wrong_vectors_ties_and_repeats(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-inf, 0.0]),
            (8, [1.0, 2.0, 3.0]), (None, [0.5, 0.5]), (None, [-0.0004, 0.0004]), (9, [0.0, 0.0]), (9, [0.0, 0.0]),
            (10, [2.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 2.0]), (13, [2.0, 2.0]), (14, [1.0, 1.0])]
    for k in (1, 2, 3, 4, 30):
        assert result(spark, rows, dims=2, k=k, rounds=4) == plain(rows, 2, k, 4)


def test_empty_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None), (2, [1.0])]) == []


def test_equal_vectors_and_one_hot_vector(spark):
    hot = [(i, [0.25, -0.75, 0.1]) for i in range(200)]
    assert result(spark, hot, dims=3) == plain(hot, 3, 8, 10)
    mixed = hot + [(1000 + i, v) for i, v in blobs(4, 100, 3)]
    assert result(spark, mixed, dims=3) == plain(mixed, 3, 8, 10)


def test_large_components_are_exact_and_too_large_ones_an_error(spark):
    rows = [(i, [v * 300_000 for v in x]) for i, x in blobs(9, 60, 4)]
    assert result(spark, rows, dims=4, k=5, rounds=3) == plain(rows, 4, 5, 3)
    with pytest.raises(Exception, match="too long for exact distances"):
        result(spark, [(1, [2e6, 0.0])], dims=2)


def rounds_of(points, centroids, rounds):
    """Every round by ``assign`` on bounds that it carries, against a full search; distances measured in each."""
    n, k = len(points), len(centroids)
    state = (np.zeros(n, dtype=np.int64), np.full(n, min(1, k - 1)), np.full(n, np.inf), np.full(n, -np.inf))
    before, measured = None, []
    for _ in range(rounds):
        *state, m = clusters.assign(points, *state, clusters.Centroids(centroids, before))
        full = np.stack([clusters.squared(points, np.broadcast_to(c, points.shape)) for c in centroids], axis=1)
        own, second, upper, lower = state
        assert (own == full.argmin(axis=1)).all()
        assert (upper >= np.sqrt(full[np.arange(n), own])).all()
        full[np.arange(n), own] = np.iinfo(np.int64).max
        assert k == 1 or (lower <= np.sqrt(full.min(axis=1))).all()
        measured.append(m)
        before = centroids
        centroids = np.stack([points[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else centroids[j]
                              for j in range(k)])
    return measured


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 12), st.integers(1, 5), st.sampled_from([2, 30, 10**6]))
def test_bounds_hold_and_nearest_is_exact(seed, k, dims, size):
    rng = np.random.default_rng(seed)
    points = rng.integers(-size, size + 1, (rng.integers(k, 80), dims))
    rounds_of(points, points[:k].copy(), 7)


def test_bounds_spare_most_distances():
    points = np.array([[math.floor(1024 * c) for c in v] for _, v in blobs(1, 3000, 16)])
    measured = rounds_of(points, points[:30].copy(), 10)
    assert measured[-1] < 0.2 * 3000 * 30


def test_query_on_given_vectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.QUERIES["op11_clusters"](spark, sf).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                             "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 64, 8, 10)
