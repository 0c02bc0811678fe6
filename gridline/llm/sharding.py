"""Sharding by rendezvous hashing over weighted shards.

Every shard draws a number for a record's key; the lowest wins. A shard's draw
doesn't depend on the other shards, so a new shard takes rows only into itself
and a removed one gives away only its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.llm.common import gapless_rank, table

SHARDS = 8


def draw(key: Column, shard: int, weight: float) -> Column:
    """The shard's draw for a key, exponentially distributed with rate weight."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard {shard}")), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return F.struct((-F.log(unit) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard (int) of a key; a null key is a key like any other."""
    usable = {k: w for k, w in weights.items() if w > 0}
    if not usable:
        raise ValueError("at least one shard needs a weight above 0")
    return F.array_min(F.array(*[draw(key, k, w) for k, w in sorted(usable.items())]))["shard"].cast("int")


def assign(df: DataFrame, key: str, weights: dict[int, float], out: str = "shard") -> DataFrame:
    """df with the shard of every row: a projection, without any shuffle.

    Only the key and the shards decide, so repeated keys share a shard, whatever
    else the rows hold. An empty table gives an empty table. A column named as
    out is replaced.
    """
    return df.withColumn(out, rendezvous(F.col(key), weights))


def write(df: DataFrame, key: str, weights: dict[int, float], path: str, rows_per_file: int = 1_000_000) -> None:
    """Write the rows as Parquet, one folder for each shard.

    Rows are dealt by shard and a hash of the key, so a shard is written by as
    many tasks as there are partitions, not by one.
    """
    placed = assign(df, key, weights, "_shard")
    dealt = placed.repartition(F.col("_shard"), F.pmod(F.xxhash64(key), F.lit(64)))
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("_shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 8 shards by law `key`, and over 9.

    A null text has size 1 and the checksum of no bytes (0). A null doc_id is
    one key. slot counts a shard's rows from 0; rows with the same doc_id,
    size and checksum may swap slots.
    """
    weights = dict.fromkeys(range(SHARDS), 1.0)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), weights | {SHARDS: 1.0}).alias("grown_shard"),
    )
    ranked = gapless_rank(placed, "shard", ["doc_id", "size", "text_crc32"], ["doc_id", "size", "text_crc32"], "slot", SHARDS)
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
