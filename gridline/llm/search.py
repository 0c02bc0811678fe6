"""Exact top-k search by distributed histogram selection.

Everything is scored, but scores stay where they are: each pass only counts
them into histograms, one per query, whose sum tells which bin holds the kth
best. The bin is split again until it's one value wide or holds few rows. A
last pass keeps scores from there on and ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridline.llm.common import bounded, cut, table

K = 10
SCALE = 1024
#: Queries in a block; a block and its histograms are what a task holds.
BLOCK = 4096
BITS = 8
#: Scores computed at once.
TILE = 1 << 20
#: A bin with so few rows beyond k isn't split again.
SLACK = 64
_BIG = 2.0**53


def scaled(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and floor(scale * x) of the usable rows, one pair for each length.

    A row takes part if its id and vector aren't null and all components are
    finite. Values are doubles that hold integers.
    """
    ids, vectors = batch.column(0), batch.column(1)
    there = pc.and_(pc.is_valid(ids), pc.is_valid(vectors))
    ids, vectors = ids.filter(there), vectors.filter(there)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(scale * vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float))
    ids, starts = ids.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        matrix = values[starts[rows, None] + np.arange(d)[None, :]]
        usable = np.isfinite(matrix).all(axis=1)
        yield ids[rows[usable]], matrix[usable]


def products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products: doubles while those are exact, else Python integers."""
    d = vectors.shape[1]
    if not d or np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * d < _BIG:
        return vectors @ queries.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return whole(vectors) @ whole(queries).T


class Block:
    """A block of queries of one length, and where the kth value of each lies.

    The kth best of query i lies in [low[i], low[i] + 2 ** (shift[i] + BITS));
    above[i] rows score higher than that. done[i]: the rows from low[i] on are
    few, or all have one score.
    """

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, largest: float):
        self.ids, self.matrix, self.k = ids, matrix, k
        bound = int(np.sqrt((matrix**2).sum(axis=1)).max(initial=0) * largest) + 1
        bits = max(bound.bit_length() + 1, BITS)
        self.low = np.array([-(1 << (bits - 1))] * len(ids), dtype=object)
        self.shift = np.full(len(ids), bits - BITS)
        self.above = np.zeros(len(ids), np.int64)
        self.done = np.zeros(len(ids), bool)

    def tiles(self, batches, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of rows and their scores by query; a query's own row scores nothing (see own)."""
        d = self.matrix.shape[1]
        for batch in batches:
            for ids, vectors in scaled(batch, scale):
                if vectors.shape[1] != d:
                    continue
                step = max(1, TILE // max(1, len(self.ids)))
                for lo in range(0, len(ids), step):
                    some = ids[lo : lo + step]
                    yield some, products(vectors[lo : lo + step], self.matrix)

    def counts(self, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Rows of each bin of each query's range."""
        width = np.array([1 << int(s) for s in self.shift], dtype=object)
        if scores.dtype != object:
            place = np.floor((scores - self.low.astype(float)) / width.astype(float))
        else:
            place = ((scores - self.low) // width).astype(float)
        fits = (place >= 0) & (place < (1 << BITS)) & (ids[:, None] != self.ids[None, :]) & ~self.done[None, :]
        code = (place + np.arange(len(self.ids))[None, :] * (1 << BITS))[fits].astype(np.int64)
        return np.bincount(code, minlength=len(self.ids) << BITS)

    def refine(self, found: dict[int, tuple[int, int, int]]) -> None:
        """found: by query the bin of the kth best, the rows in bins above it and in it."""
        for i in np.flatnonzero(~self.done):
            if i not in found:  # fewer than k rows: all are taken
                self.low[i], self.done[i] = -(1 << 200), True
                continue
            at, more, inside = found[i]
            self.low[i] += at << int(self.shift[i])
            self.above[i] += more
            self.done[i] = self.shift[i] == 0 or self.above[i] + inside <= self.k + SLACK
            self.shift[i] = max(0, self.shift[i] - BITS)

    def best(self, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores of this tile's k best rows of each query, from low on."""
        low = self.low if scores.dtype == object else np.maximum(self.low, -(1 << 60)).astype(float)
        row, q = np.nonzero((scores >= low) & (ids[:, None] != self.ids[None, :]))
        return top(q, ids[row], scores[row, q], self.k)


def top(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: highest score, then smallest id."""
    order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -scores[i], ids[i])), dtype=int) if scores.dtype == object else np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[keep], scores[keep]


def longs(scores: np.ndarray) -> pa.Array:
    """Scores as longs; beyond their range the nearest long."""
    return pa.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores], pa.int64())


def search_block(rows: DataFrame, block: Block, scale: int) -> DataFrame:
    """The k best rows of every query of a block: query_id, rank, vec_id, score."""
    context = rows.sparkSession.sparkContext
    while not block.done.all():
        state = context.broadcast(block)

        def count(batches, state=state):
            own: Block = state.value
            total = np.zeros(len(own.ids) << BITS, np.int64)
            for ids, scores in own.tiles(batches, scale):
                total += own.counts(ids, scores)
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(full >> BITS, pa.int64()), pa.array(full & ((1 << BITS) - 1), pa.int64()), pa.array(total[full], pa.int64())], names=["q", "bin", "n"])

        histogram = rows.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        higher = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        counted = histogram.withColumn("more", F.coalesce(F.sum("n").over(higher), F.lit(0)))
        need = rows.sparkSession.createDataFrame([(int(i), int(block.k - block.above[i])) for i in np.flatnonzero(~block.done)], "q long, need long")
        counted = counted.join(F.broadcast(need), "q")  # a block has 4096 queries at most
        kth = counted.where((F.col("more") < F.col("need")) & (F.col("more") + F.col("n") >= F.col("need")))
        block.refine({r["q"]: (r["bin"], r["more"], r["n"]) for r in kth.select("q", "bin", "more", "n").collect()})
        state.destroy()
    state = context.broadcast(block)

    def keep(batches):
        own: Block = state.value
        held = [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        for ids, scores in own.tiles(batches, scale):
            new = own.best(ids, scores)
            held = list(top(*(np.concatenate(x) for x in zip(held, new, strict=True)), own.k))
        yield pa.RecordBatch.from_arrays([pa.array(own.ids[held[0].astype(int)], pa.int64()), pa.array(held[1], pa.int64()), longs(held[2])], names=["query_id", "vec_id", "score"])

    kept = rows.mapInArrow(keep, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", place).where(F.col("rank") <= block.k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """Each query's k best rows by integer inner product, ties to the smaller id.

    vectors and queries: (vec_id long, embedding array<float or double>). A
    query is compared with all rows of its length but those of its own id; with
    fewer than k of them all are returned. Null ids, null vectors and vectors
    with a null or non-finite component take no part. Of several queries with
    one id the one with the smallest vector counts; repeated rows are
    candidates as often as they stand. Scores beyond a long are cut to it.
    Queries are taken in blocks of 4096 and each block is a few passes over all
    rows without a shuffle of rows; a task sends k rows for each query of the
    block at most. No rows or no queries give an empty result.
    """
    spark = vectors.sparkSession
    bounded(spark)
    rows = vectors.select("vec_id", "embedding")

    def norm(batches):
        most = 0.0
        for batch in batches:
            for _, m in scaled(batch, scale):
                most = max(most, float(np.sqrt((m**2).sum(axis=1)).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    def lengths(batches):
        for batch in batches:
            for ids, m in scaled(batch, scale):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["vec_id", "v"])

    usable = queries.select("vec_id", "embedding").mapInArrow(lengths, "vec_id long, v array<double>")
    usable = usable.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v")).orderBy("d", "vec_id")
    largest, found, held = None, [], []

    def done() -> None:
        nonlocal largest
        if held:
            if largest is None:
                largest = rows.mapInArrow(norm, "most double").agg(F.max("most")).first()[0] or 0.0
            matrix = np.array([r["v"] for r in held], dtype=float).reshape(len(held), -1)
            found.append(Block(np.array([r["vec_id"] for r in held], np.int64), matrix, k, largest))
            held.clear()

    out = None
    for r in usable.toLocalIterator():
        if held and (len(held) == block or held[0]["d"] != r["d"]):
            done()
            part = cut(search_block(rows, found.pop(), scale))
            out = part if out is None else out.unionByName(part)
        held.append(r)
    done()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    part = search_block(rows, found.pop(), scale)
    return part if out is None else out.unionByName(part)


def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP1_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""
