"""Ball k-means against the plain method with Python's integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridline.llm import centroids

MOST = (1 << 63) - 1


def plain(rows, clusters, rounds, dimensions, scale=64, seed=1):
    kept = [(i, [int(math.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:clusters]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        own = nearest()
        for j in range(len(centres)):
            members = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]
            if members:
                centres[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = nearest()
    total = sum(d for d, _ in own)
    of = {j: sum(d for d, c in own if c == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, j, min(d, MOST), min(of[j], MOST), min(total, MOST), digest[j]) for (i, _), (d, j) in zip(kept, own, strict=True)], key=repr)


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.select("*", F.lit(1).alias("cluster"), F.lit("x").alias("distance"), F.lit("y").alias("a.b"), F.create_map(F.lit("k"), F.lit(1)).alias("row")).repartition(4)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_clusters_are_those_of_the_plain_method(spark, seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(300, 5)) + rng.integers(0, 4, size=(300, 1)) * 3
    if seed % 2:
        points = np.round(points)  # many ties
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(300), points, strict=True)]
    rows += [rows[3]] * 200 + [(None, rows[5][1]), (900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 5), (904, []), (905, [1.0] * 4)]
    assert got(centroids.ball_kmeans(frame(spark, rows), clusters=9, rounds=4, dimensions=5)) == plain(rows, 9, 4, 5)


def test_large_components_are_exact(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([[3e30, 1.0], [-3e30, 2.0], [1e12, -1e12], [0.5, 0.25], [1.0, 1.0], [2.9e30, 7.0], [1e12, 1e12], [-0.01, -2.0]])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got(centroids.ball_kmeans(frame(spark, rows), clusters=3, rounds=3, dimensions=2)) == plain(rows, 3, 3, 2)


def test_empty_clusters_stay_and_few_vectors_are_few_clusters(spark):
    rows = [(i, [1.0, 2.0]) for i in range(6)] + [(50, [5.0, 5.0])]
    assert got(centroids.ball_kmeans(frame(spark, rows, "double"), clusters=4, rounds=3, dimensions=2)) == plain(rows, 4, 3, 2)
    assert got(centroids.ball_kmeans(frame(spark, rows[5:]), clusters=16, rounds=3, dimensions=2)) == plain(rows[5:], 16, 3, 2)
    assert got(centroids.ball_kmeans(frame(spark, []), dimensions=2)) == []


def test_only_neighbours_are_compared(monkeypatch):
    rng = np.random.default_rng(5)
    centres = [[int(x) for x in c] for c in rng.integers(-5000, 5000, size=(40, 8))]
    rows = (np.array(centres)[rng.integers(0, 40, 2000)] + rng.integers(-60, 60, size=(2000, 8))).astype(np.int64)
    balls = centroids.Balls(centres)
    own, best = balls.first(rows)
    compared = []
    squared = centroids.squared
    monkeypatch.setattr(centroids, "squared", lambda a, b: compared.append(len(a)) or squared(a, b))
    again, distance = balls.moved(rows, own)
    assert (again == own).all() and (distance == best).all()
    assert sum(compared) < 2 * len(rows)  # their own centroid, and hardly another; the plain method takes 40


def test_sums_in_pieces():
    for value in (0, 5, -5, 1 << 62, -(1 << 62) - 1, 1 << 200, -(3**100)):
        assert sum(piece << (centroids.LIMB * limb) for limb, piece in centroids.limbs(value)) == value
        assert all(-(1 << 62) <= piece < 1 << 62 for _, piece in centroids.limbs(value))
