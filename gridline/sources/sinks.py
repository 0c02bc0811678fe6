"""Sinks: records as JSON, small results as a workbook, texts as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridline.operators.tables import resolved
from gridline.sources.json_rows import csv_tables, read_json
from gridline.sources.office import workbook

SHEET_ROWS = 1_048_576


def write_records(records: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One JSON object for each record (array<struct<key, value>> rec), partitioned by keys."""
    as_map = F.map_from_entries("rec")
    records.withColumn("rec", as_map).write.mode("overwrite").partitionBy(*keys).json(path)


def write_tables(rows: DataFrame, headed: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Tables of cells as JSON records, their header resolved first: see tables.resolved."""
    write_records(resolved(rows, list(keys), headed), path, keys)


def export_records(spark: SparkSession, source: str, dimensions: str) -> bytes:
    """A workbook of the records of a JSON file as sheet INPUT, and of each CSV file of a folder as a sheet in capitals.

    Raises if there are no records.
    """
    records = read_json(spark, source)
    if records.isEmpty():
        raise ValueError(f"{source}: no records")
    return to_workbook({"INPUT": records} | csv_tables(spark, dimensions))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def to_workbook(sheets: dict[str, DataFrame], most: int = 100_000) -> bytes:
    """Small results as a workbook, headers first; more than most rows of a sheet are an error.

    For larger results write Parquet or CSV.
    """
    out, widths = {}, {}
    for name, df in sheets.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > min(most, SHEET_ROWS - 1):
            raise ValueError(f"{name}: over {most} rows; write Parquet or CSV")
        out[name] = [df.columns, *[[None if v is None else str(v) for v in r] for r in rows]]
        widths[name] = [max(10, min(100, 2 + max(len(line) for v in column for line in (v or "").split("\n")))) for column in zip(*out[name], strict=True)]
    return workbook(out, widths)


def log_answers(answers: DataFrame, path: str) -> None:
    """Append prompts and answers of a model to a log, with the time."""
    answers.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)
