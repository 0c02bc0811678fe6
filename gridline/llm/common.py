"""What several operators share: words, checkpoints and ranks without gaps."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"

#: Rows that may be broadcast as a table of counted groups.
BROADCAST_ROWS = 100_000

#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20

#: Slices into which a ranked group is dealt, so that no task ranks a whole group.
SLICES = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where that is unset a temporary folder is used, but only by a master that
    runs in this process (tests); elsewhere executors don't share it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridline-checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def quoted(name: str) -> Column:
    """The column of a name that may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def bounded(spark: SparkSession) -> None:
    """Let Arrow batches hold about BATCH_BYTES bytes at most from here on.

    Spark has no other place for this limit than the session; a smaller one of
    the caller stays. A single row may be larger: a text is never cut.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", str(spark.conf.get(key, None)).lower())
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def parts(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of which the column holds about so many bytes; at least a row each."""
    step = max(1, batch.num_rows * most // max(1, batch.column(column).nbytes))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark can write to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def with_columns(df: DataFrame, keep: tuple[str, ...], added: str) -> StructType:
    """The schema of keep's columns of df and of added (DDL)."""
    return StructType([*[df.schema[c] for c in keep], *StructType.fromDDL(added)])


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only if it was counted to hold few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slice_of(*key: str, slices: int = SLICES) -> Column:
    return F.pmod(F.xxhash64(F.lit("slice"), *key), F.lit(slices)).cast("int")


def gapless_rank(df: DataFrame, group: str, key: list[str], order: list[str], out: str, groups_bound: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in two levels.

    Equal rows are counted first, so that a row that stands very often is one
    row of the ranking, and are written out again behind it. Rows are dealt
    into slices by a hash of key and ranked inside their slice only; the count
    of all earlier slices of the group is added. key should tell rows apart,
    for those of one key are one slice. group must not be null. Rows
    that tie in order must be equal in all columns of df, so either numbering
    of them is the same result.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_slice", slice_of(*key))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = df.groupBy(group, slice_of(*key).alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    counts = slices.select(group, "_slice", earlier(Window.partitionBy(group).orderBy("_slice")).alias("_before"))
    if groups_bound * SLICES <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    inside = Window.partitionBy(group, "_slice").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    ranked = counted.withColumn("_first", earlier(inside)).join(counts, [group, "_slice"])
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_copy")
    return ranked.select(*df.columns, (F.col("_before") + F.col("_first")).alias("_at"), copies).select(*df.columns, (F.col("_at") + F.col("_copy")).alias(out))
