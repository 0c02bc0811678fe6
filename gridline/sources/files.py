"""One scan over files of all kinds: rows of cells, and a status for each file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.sources import office, text  # noqa: F401 - they register their readers
from gridline.sources.registry import readers, suffix

SCHEMA = "path string, status string, error string, table_id int, table_name string, row_idx int, cells array<string>"


def read_files(files: DataFrame) -> DataFrame:
    """Rows of files(path, content), one at least for each file.

    status is `ok`, `empty`, `unsupported` or `failed` (then with error); a
    file never stops the others. Files are decoded where they were read, so a
    scan has no shuffle.
    """

    known = readers()

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                read = known.get(suffix(path))
                if read is None:
                    out.append((path, "unsupported", None, None, None, None, None))
                    continue
                try:
                    tables = read(path.rsplit("/", 1)[-1], bytes(content))
                except Exception as e:  # noqa: BLE001 - the row says what was wrong with the file
                    out.append((path, "failed", str(e), None, None, None, None))
                    continue
                rows = [(path, "ok", None, t, name, r, row) for t, (name, table) in enumerate(tables) for r, row in enumerate(table)]
                out += rows or [(path, "empty", None, None, None, None, None)]
            frame = pd.DataFrame(out, columns=[f.split(" ")[0] for f in SCHEMA.split(", ")])
            yield frame.astype({"table_id": "Int32", "row_idx": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return read_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder))


def statuses(rows: DataFrame) -> DataFrame:
    """status, files."""
    return rows.groupBy("status").agg(F.count_distinct("path").alias("files"))


def pictures(files: DataFrame) -> DataFrame:
    """path, name, content of every picture inside word-processor files; a broken file has none."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += [(path, name, data) for name, data in office.images(bytes(content))]
                except Exception:  # noqa: BLE001, S112 - its status is read_files' matter
                    continue
            yield pd.DataFrame(out, columns=["path", "name", "content"])

    words = files.where(F.lower("path").endswith(".docx"))
    return words.select("path", "content").mapInPandas(run, "path string, name string, content binary")


def folder_size(files: DataFrame) -> DataFrame:
    """One row: files, bytes, size (human-readable) of files(length)."""
    from gridline.functions.text import human_size

    total = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))
    return total.withColumn("size", human_size(F.col("bytes")))
