"""Centroid clustering against plain integer k-means, the filter's saving, odd vectors."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from plumeflux.llm import centroid_filter


def plain(rows, k, rounds, width):
    """The contract in plain Python integers."""
    kept = [(i, [math.floor(256 * x) if math.isfinite(256 * x) else 256 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    raw = {id(v): n for n, (_, v) in enumerate(kept)}
    order = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs)]
    assert raw
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    return found, centroids


def test_like_plain_integers(spark):
    rng = random.Random(11)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(base)]) for i in range(300)]
    rows += [rows[5], rows[5], (5, [0.5] * 8), (None, [0.25] * 8), (None, [-0.25] * 8)]
    rows += [(900, None), (901, [1.0] * 7), (902, [1.0] * 7 + [None]), (903, [1.0] * 7 + [float("nan")]), (904, [float("inf")] * 8), (905, []), (906, [0.0] * 8)]
    rows += [(910 + k, [1e12 * k] * 8) for k in (-2, 1)] + [(920, [3e307] * 8), (921, [-0.001] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    df = df.select("*", *[F.lit(1).alias(c) for c in ("vec", "ints", "lead", "rest", "cluster", "distance")])
    want, centroids = plain(rows, 9, 5, 8)
    found, got_centroids = centroid_filter.cluster(df, k=9, rounds=5, width=8, lead=3)
    cap = (1 << 63) - 1
    assert got_centroids == centroids
    assert sorted(map(str, found.collect())) == sorted(f"Row(vec_id={i}, cluster={k}, distance={min(d, cap)})" for i, k, d in want)


def test_report(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(50)]
    got = centroid_filter.cluster_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5, width=4)
    rows32 = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    want, centroids = plain(rows32, 5, 5, 4)
    sums = {}
    for _, k, d in want:
        sums[k] = sums.get(k, 0) + d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert sorted(map(tuple, got.collect())) == sorted((i, k, d, sums[k], sum(sums.values()), shas[k]) for i, k, d in want)


def test_fewer_vectors_than_centroids_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(1, [0.0] * 64), (2, [1.0] * 64)], schema)
    assert {(r.vec_id, r.distance) for r in centroid_filter.cluster_report(few).collect()} == {(1, 0), (2, 0)}
    for rows in ([], [(1, None), (2, [1.0])]):
        got = centroid_filter.cluster_report(spark.createDataFrame(rows, schema))
        assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_filter_spares_distances_and_loses_none():
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 300, (40, 64))
    m = np.floor(centers[rng.integers(0, 40, 5000)] + rng.normal(0, 30, (5000, 64)))
    rotation = centroid_filter.Rotation(m.sum(0), m.T @ m, len(m), 16)
    nearest = centroid_filter.Nearest(np.floor(centers).astype(int).tolist(), rotation)
    clusters, distances, measured = nearest.by_filter(m.astype(np.int64), *rotation.turn(m))
    exact = ((m[:, None, :] - np.floor(centers)[None]) ** 2).sum(2)
    assert (clusters == exact.argmin(1)).all() and (distances == exact.min(1)).all()
    assert measured < 3 * len(m)  # of 40 per vector
