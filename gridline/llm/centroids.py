"""Centroid clustering by ball k-means.

A cluster is a ball: its centroid, and a radius that no member exceeds. A
member nearer to its centroid than half the way to the next one is in the
stable core and can't move. Half the ways to further centroids cut the ball
into annuli: a member in the t-th is compared with the t nearest neighbours
only, all of which the radius must reach. The assignment is that of the plain
method, ties included, for a centroid is left out only if it's farther.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.llm.common import bounded, cut, remove, shared_folder, table
from gridline.llm.search import scaled

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Components are 64-bit integers if none is larger and there are so many at most, else Python's own.
SMALL, SHORT = 1 << 24, 1 << 11
#: A sum is sent in pieces of so many bits.
LIMB = 62
_MOST = (1 << 63) - 1


def whole(matrix: np.ndarray) -> np.ndarray:
    """Integers of doubles that hold integers, of a type that squared distances fit."""
    if np.abs(matrix).max(initial=0) <= SMALL and matrix.shape[1] <= SHORT:
        return matrix.astype(np.int64)
    return np.array([[int(x) for x in row] for row in matrix], dtype=object).reshape(matrix.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and b, or of one row b."""
    if a.dtype != b.dtype:
        a, b = a.astype(object), b.astype(object)
    apart = a - b
    return (apart * apart).sum(axis=1)


class Balls:
    """Centroids, and for each the others from near to far with the squared ways to them."""

    def __init__(self, centroids: list[list[int]]):
        large = max((abs(x) for c in centroids for x in c), default=0) > SMALL or any(len(c) > SHORT for c in centroids)
        self.centroids = np.array(centroids, dtype=object if large else np.int64).reshape(len(centroids), -1)
        self.near, self.ways = [], []
        for i in range(len(centroids)):
            ways = squared(self.centroids, self.centroids[i])
            others = np.array([j for j in np.argsort(ways, kind="stable") if j != i], dtype=int)
            self.near.append(others)
            self.ways.append(ways[others])

    def first(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of rows that belong to none yet, and the squared distance."""
        return self.moved(rows, np.zeros(len(rows), int))

    def moved(self, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for members of the balls own; ties go to the smaller number."""
        cluster, best = own.copy(), np.zeros(len(rows), rows.dtype)
        for i in np.unique(own):
            members = np.flatnonzero(own == i)
            distance = squared(rows[members], self.centroids[i])
            # a neighbour is farther than the centroid if the way to it is over twice the member's
            reach = distance * 4
            radius = reach.max()
            neighbours = int(np.searchsorted(self.ways[i], radius, side="right"))
            annulus = np.searchsorted(self.ways[i][:neighbours], reach, side="right")
            at = np.full(len(members), i)
            for t in range(neighbours):
                inside = np.flatnonzero(annulus > t)
                j = self.near[i][t]
                other = squared(rows[members[inside]], self.centroids[j])
                if other.dtype != distance.dtype:
                    distance, other = distance.astype(object), other.astype(object)
                nearer = (other < distance[inside]) | ((other == distance[inside]) & (j < at[inside]))
                distance[inside[nearer]], at[inside[nearer]] = other[nearer], j
            if distance.dtype != best.dtype:
                best = best.astype(object)
            cluster[members], best[members] = at, distance
        return cluster, best


def kept(batch: pa.RecordBatch, dimensions: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The row numbers and integer vectors of a batch (row, vector) that take part."""
    for rows, matrix in scaled(batch, scale):
        if matrix.shape[1] == dimensions:
            yield rows, whole(matrix)


def limbs(value: int) -> list[tuple[int, int]]:
    """number, piece of an integer: pieces times 2**(LIMB * number) add up to it, and so do sums of pieces."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append((len(out), value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return [*out, (len(out), value)]


def starts(vectors: DataFrame, clusters: int, seed: int) -> DataFrame:
    """The vectors of the least SHA-256 of `seed:id`, in that order; of one id the smaller vector first, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return vectors.select(order.alias("_order"), "embedding").orderBy(F.asc_nulls_last("_order"), "embedding").limit(clusters)


def ball_kmeans(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector.

    vectors: (vec_id, embedding array<float or double>); components become
    floor(scale * x). Vectors of another length, null, or with a component that
    is null or not finite (scaled, too) take no part; repeated rows count as often as they
    stand, null ids are kept but start a cluster only where ids are too few.
    Each round assigns all vectors and moves centroids to the floor of the mean
    of each component; a last assignment follows. Empty clusters stay where
    they are, fewer vectors than clusters give fewer clusters, none an empty
    result. Sums and distances are exact; beyond a long they're cut to it.

    A pass maps over the vectors, which stay where they are, and sends a sum of
    each cluster and component: clusters * dimensions rows a task, added up in
    Spark. The members' clusters are written with the vectors, to the shared
    folder; files of a round go when the next has written its own. The driver
    and each task hold the centroids only (clusters * dimensions numbers).
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded(spark)
    key = vectors.schema["vec_id"].dataType.simpleString()
    folder = f"{shared_folder(spark)}/balls-{uuid.uuid4().hex}"
    usable = vectors.select("vec_id", "embedding").where(F.size("embedding") == dimensions)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf"))
    usable = usable.where(F.forall("embedding", fine))

    def integers(values: list[float]) -> list[int]:
        return [int(x) for x in np.floor(scale * np.array(values, float))]

    centroids = [integers(r["embedding"]) for r in starts(usable, clusters, seed).collect()]
    if not centroids:
        return spark.createDataFrame([], f"vec_id {key}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def assigned(rows: DataFrame, balls: Balls, first: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(balls)

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                own = None if first else batch.column("cluster").to_numpy()
                cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
                numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("embedding")], names=["row", "embedding"])
                for places, matrix in kept(numbered, dimensions, scale):
                    cluster[places], distance[places] = shared.value.first(matrix) if first else shared.value.moved(matrix, own[places])
                columns = [batch.column("vec_id"), batch.column("embedding"), pa.array(cluster), pa.array([min(int(x), _MOST) for x in distance], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "embedding", "cluster", "distance"])

        return rows.mapInArrow(run, f"vec_id {key}, embedding {rows.schema['embedding'].dataType.simpleString()}, cluster int, distance long")

    def sums(batches: Iterator[pa.RecordBatch]):
        """cluster, place (-1: rows), limb, n of a task's rows."""
        total: dict[int, list[int]] = {}
        for batch in batches:
            own = batch.column("cluster").to_numpy()
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("embedding")], names=["row", "embedding"])
            for places, matrix in kept(numbered, dimensions, scale):
                for i in np.unique(own[places]):
                    members = matrix[own[places] == i]
                    held = total.setdefault(int(i), [0] * (dimensions + 1))
                    total[int(i)] = [a + int(b) for a, b in zip(held, [len(members), *members.sum(axis=0)], strict=True)]
        rows = [(i, place - 1, limb, piece) for i, values in total.items() for place, value in enumerate(values) for limb, piece in limbs(value)]
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "place", "limb", "n"])

    rows = usable
    for number in range(rounds + 1):
        assigned(rows, Balls(centroids), number == 0).write.parquet(f"{folder}/{number}")
        rows = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
        if number == rounds:
            break
        added = rows.select("embedding", "cluster").mapInArrow(sums, "cluster int, place int, limb int, n long")
        found: dict[int, list[int]] = {}
        for r in added.groupBy("cluster", "place", "limb").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
            found.setdefault(r["cluster"], [0] * (dimensions + 1))[r["place"] + 1] += int(r["n"]) << (LIMB * r["limb"])
        for i, (count, *values) in found.items():
            centroids[i] = [value // count for value in values]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    of_cluster = {r["cluster"]: int(r["sum"]) for r in inertia.collect()}  # a row for each cluster
    all_of_it = min(sum(of_cluster.values()), _MOST)
    facts = [(i, min(of_cluster.get(i, 0), _MOST), all_of_it, digest) for i, digest in enumerate(digests)]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = cut(rows.select("vec_id", "cluster", "distance"))
    remove(spark, folder)
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ball k-means of all embeddings; nulls, ties, repeated rows and empty tables as ball_kmeans says."""
    return ball_kmeans(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = [
        f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS cluster, v FROM e
  ORDER BY sha256('1:' || vec_id), v LIMIT {CLUSTERS}
)"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, min({{'d': d, 'cluster': cluster}}) AS best FROM (
    SELECT n, vec_id, e.v, cluster, CAST(list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM (SELECT row_number() OVER () AS n, * FROM e) e, c{r} c)
  GROUP BY n, vec_id
)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM (
    SELECT best.cluster AS cluster, place, sum(x) AS s, count(*) AS n
    FROM (SELECT best, unnest(v) AS x, unnest(range({DIMENSIONS})) AS place FROM a{r}) GROUP BY ALL)
  GROUP BY cluster
), c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return (
        ",\n".join(steps)
        + f"""
SELECT vec_id, best.cluster AS cluster, best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.cluster = best.cluster
"""
    )


OP12_SQL = _sql()
