"""Packing into length buckets that minimise padding.

A global histogram of lengths goes to the driver (its number of cells is
bounded), dynamic programming picks the bucket boundaries that pad least, and
batches of a length budget form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.llm.common import cut, gapless_rank, table, word_count

BUCKETS = 16
#: Padded lengths of a batch, in the unit of the lengths.
BUDGET = 16_384

#: Lengths up to this have a cell of their own; beyond, each doubling has half as many cells.
EXACT = 512


def cell(length: Column) -> Column:
    """The histogram cell of a length: its upper end, at most 1/256 above it.

    There are 256 cells for each doubling beyond 512, so a histogram of 63-bit
    lengths has fewer than 15,000 cells, whatever the number of rows.
    """
    step = F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)))).cast("int") - 8, F.lit(0))
    width = F.pow(F.lit(2.0), step).cast("long")
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / width).cast("long") * width)


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The bucket lengths that pad least: ascending, the last is the largest length.

    best[j] is the least padded volume of the cells up to j with the buckets so
    far; one more bucket ending at j costs length[j] * (rows after i up to j).
    """
    length, rows = np.asarray(lengths, dtype=float), np.concatenate([[0], np.cumsum(counts)]).astype(float)
    m = len(lengths)
    best, cuts = length * rows[1:], []
    for _ in range(1, min(buckets, m)):
        new, cut_at = best.copy(), np.full(m, -1)
        for lo in range(0, m, 256):
            hi = min(lo + 256, m)
            cost = best[None, :hi] + length[lo:hi, None] * (rows[lo + 1 : hi + 1, None] - rows[None, 1 : hi + 1])
            cost[np.arange(hi)[None, :] >= np.arange(lo, hi)[:, None]] = np.inf
            at = cost.argmin(axis=1)
            low = cost[np.arange(hi - lo), at]
            better = low < new[lo:hi]
            new[lo:hi][better], cut_at[lo:hi][better] = low[better], at[better]
        cuts.append(cut_at)
        best = new
    out, j = [], m - 1
    for cut_at in reversed(cuts):
        out.append(int(lengths[j]))
        if cut_at[j] >= 0:
            j = int(cut_at[j])
    out.append(int(lengths[j]))
    return sorted(set(out))


def pack(docs: DataFrame, length: Column, buckets: int = BUCKETS, budget: int = BUDGET, keep: tuple[str, ...] = ("doc_id",), name: str = "length") -> DataFrame:
    """Every row of docs with its bucket and its place in a batch.

    name long (the length in any unit, which budget is counted in as well; null
    counts as 0), bucket int (from 0), bucket_len
    long (every row of the bucket is padded to it), padding long, batch long
    (from 0 in each bucket), place int (from 0 in the batch). A batch of a
    bucket holds budget // bucket_len rows, one at least: a row longer than the
    budget is a batch of its own and isn't cut. Rows keep their number: nothing
    is dropped. Rows are dealt to batches by a hash of doc_id, so the rows of a
    batch are spread over the corpus. keep must not name one of these columns.
    Rows equal in all of keep and length take any of their places. An empty
    table gives an empty one.

    Boundaries are optimal among lengths up to 512 and among the longest ones
    of cells of 1/256 beyond; see cell.
    """
    clash = set(keep) & {name, "bucket", "bucket_len", "padding", "batch", "place"}
    if clash:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    sized = cut(docs.select(*keep, F.coalesce(length, F.lit(0)).cast("long").alias("_size")))
    histogram = sized.groupBy(cell(F.col("_size")).alias("c")).agg(F.count(F.lit(1)).alias("rows"), F.max("_size").alias("longest")).orderBy("c").collect()
    ends = boundaries([r["longest"] for r in histogram], [r["rows"] for r in histogram], buckets) if histogram else [0]
    array = F.array(*[F.lit(e).cast("long") for e in ends])
    bucket = F.size(F.filter(array, lambda e: e < F.col("_size")))
    placed = sized.withColumn("bucket", bucket).withColumn("bucket_len", F.element_at(array, F.col("bucket") + 1))
    ranked = gapless_rank(placed, "bucket", [*keep, "_size"], [*keep, "_size"], "_rank", buckets)
    rows = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1)).cast("long")
    return ranked.select(
        *keep,
        F.col("_size").alias(name),
        "bucket",
        "bucket_len",
        (F.col("bucket_len") - F.col("_size")).alias("padding"),
        F.floor(F.col("_rank") / rows).cast("long").alias("batch"),
        (F.col("_rank") % rows).cast("int").alias("place"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed by words: real token counts would take longer than the packing itself."""
    return pack(table(spark, sf_dir, "documents"), word_count(F.col("text")), name="n_words")
