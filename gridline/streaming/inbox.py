"""An inbox of files as a stream: each upload is read once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.functions.text import signature
from gridline.sources.files import read_files

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files of a folder."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)


def once(files: DataFrame, within: str = "1 day") -> DataFrame:
    """Files without those of the same name, size and content seen within the time before.

    The state holds a signature for each file of that time.
    """
    name = F.element_at(F.split("path", "/"), -1)
    signed = files.withColumn("sig", signature(name, F.col("content")))
    if files.isStreaming:
        return signed.withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["sig"])
    return signed.dropDuplicates(["sig"])


def process(spark: SparkSession, folder: str, out: str, checkpoint: str, within: str = "1 day"):
    """Read all new files of an inbox into a Parquet table of rows, then stop."""
    rows = read_files(once(uploads(spark, folder), within))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(logs: DataFrame, days: int, now) -> DataFrame:
    """Rows of logs(modificationTime) not older than days."""
    return logs.where(F.col("modificationTime") >= F.lit(now) - F.expr(f"INTERVAL {int(days)} DAYS"))
