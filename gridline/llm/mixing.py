"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight. A source whose share
exceeds its maximum number of epochs is clamped there and the excess goes to
the others by weight, until none is above. The fixed point is one water level:
target = min(cap, level * weight). Sorted by cap / weight, source i is clamped
exactly if its ratio is at most the level that would serve it and all later
ones, so one ordered pass over the sources finds the level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridline.llm.common import cut, small, table, word_count

#: Weights dealt to the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"


def levels(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Targets of sources(source, source_size, weight): one row for each source.

    The windows run over one row per source, a table already aggregated; they
    are one task each, so sources may be some millions, not more.
    """
    upto = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    capped = sources.withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    served = capped.withColumn(
        "_level",
        (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    level = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(everything)
    wanted = F.when((F.col("_ratio") <= F.col("_level")) | level.isNull(), F.col("_cap")).otherwise(F.col("weight") * level)
    return served.withColumn("target", wanted).drop("_cap", "_ratio", "_level")


def place(seed: str) -> Column:
    """A document's place in the order of its source: a seeded hash of doc_id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """A row for each source of sized(doc_id, source, size, _key): what the mix takes of it.

    _whole copies of every document and one more of those before _end in the
    order (_key, doc_id, size); without a fraction _end is null, so that texts
    without words aren't copied beyond max_epochs either. The order is found in two levels: sums over
    4096 slices of the hash tell which slice the fraction ends in, and only
    that slice is sorted.
    """
    slices = cut(sized.groupBy("source", F.substring("_key", 1, 3).alias("_slice")).agg(F.sum("size").alias("_words")))
    per_source = slices.groupBy("source").agg(F.sum("_words").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    dealt = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (number % len(weights) + 1).cast("int")))
    targets = levels(dealt, share, max_epochs).select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_whole"),
    )
    targets = targets.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    same_source = F.col("source").eqNullSafe(F.col("_source"))
    upto = F.sum("_words").over(Window.partitionBy("source").orderBy("_slice"))
    ended = slices.withColumn("_upto", upto).join(targets, same_source).where((F.col("_rest") > 0) & (F.col("_upto") > F.col("_rest")))
    ended = ended.groupBy("_source", "source_size", "target", "_whole", "_rest").agg(
        F.min_by(F.struct(F.col("_slice").alias("at"), (F.col("_upto") - F.col("_words")).alias("before")), "_slice").alias("_cut")
    )
    ended = cut(ended)
    order = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = sized.join(small(ended), same_source).where(F.substring("_key", 1, 3) == F.col("_cut.at"))
    earlier = F.col("_cut.before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    first_out = inside.withColumn("_earlier", earlier).where(F.col("_earlier") + F.col("size") / 2 > F.col("_rest"))
    ends = first_out.groupBy("source").agg(F.min(F.struct("_key", "doc_id", "size")).alias("_end"))
    ends = ends.select(F.col("source").alias("_s"), "_end")
    # a slice of which every document is in ends behind all keys that begin with it
    behind = F.struct(F.concat("_cut.at", F.lit("g")).alias("_key"), F.lit(None).cast(sized.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("size"))
    whole = ended.join(ends, F.col("_source").eqNullSafe(F.col("_s")), "left").select("_source", "source_size", "target", "_whole", F.coalesce("_end", F.when(F.col("_cut").isNotNull(), behind)).alias("_end"))
    rest = targets.select("_source", "source_size", "target", "_whole").join(whole.select(F.col("_source").alias("_s"), "_end"), F.col("_source").eqNullSafe(F.col("_s")), "left")
    return cut(rest.drop("_s"))


def mix(
    docs: DataFrame,
    size: Column,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
    keep: tuple[str, ...] = ("doc_id", "source"),
) -> DataFrame:
    """keep (with doc_id and source), size, source_size, target, epochs of every row.

    Each source takes floor(target / source_size) copies of every document, and
    one more of the documents that come first in the order of a seeded hash of
    doc_id, until the fraction is reached: a document is in if its middle word
    is. So a source misses its target by half a document at most. epochs are
    the whole copies of a row.

    Ids, sources and sizes are computed once and kept for the plan, a row for
    each source; the rows themselves only meet the plan, as a broadcast where
    there are few sources. A null source is a source of its own, null doc_ids
    share a place in the order, a source without words has target 0; an empty
    table gives an empty one. Rows that tie are equal in doc_id and size, so
    that reruns give the same rows.
    """
    narrow = set(keep) <= {"doc_id", "source"}
    sized = cut(docs.select("doc_id", "source", size.cast("long").alias("size"), place(seed).alias("_key")))
    found = plan(sized, weights, share, max_epochs)
    rows = sized if narrow else docs.select(*keep, size.cast("long").alias("size"), place(seed).alias("_key"))
    joined = rows.join(small(found), F.col("source").eqNullSafe(F.col("_source")), "left")
    more = F.coalesce(F.struct("_key", "doc_id", "size") < F.col("_end"), F.lit(False))
    return joined.select(*keep, "size", "source_size", "target", (F.col("_whole") + more.cast("long")).alias("epochs"))


def repeat(rows: DataFrame) -> DataFrame:
    """The mix itself: every row as often as its column epochs says; null epochs are none.

    epochs is dropped. Other columns stay, but for one named _copy.
    """
    copies = F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int")))
    return rows.where(F.col("epochs") > 0).withColumn("_copy", copies).drop("_copy", "epochs")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), word_count(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r
), t AS (
  SELECT source, source_size,
         CASE WHEN ratio <= level OR (max(level) FILTER (WHERE ratio > level) OVER ()) IS NULL THEN cap
              ELSE w * (max(level) FILTER (WHERE ratio > level) OVER ()) END AS target
  FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
)
SELECT d.doc_id, d.size, p.source_size, CAST(p.target AS DOUBLE) AS target,
       CAST(d.size * (p.whole + CASE WHEN coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE
              <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""
