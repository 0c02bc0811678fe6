"""JSON and JSON lines, with schemas from header-only CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array or object as rows; NaN is a value."""
    reader = spark.read.option("multiLine", True).option("allowNonNumericNumbers", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A row for each line; blank lines are none."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def csv_columns(spark: SparkSession, path: str, separator: str = ",") -> list[str]:
    """The header of a CSV file; no row is read."""
    return spark.read.option("header", True).option("sep", separator).csv(path).columns


def csv_tables(spark: SparkSession, folder: str, separator: str = ",") -> dict[str, DataFrame]:
    """Every CSV file of a folder as text columns, by its name in capitals, in order of the names.

    A file without rows gives an empty table; only names come to the driver.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    paths = sorted(r["path"] for r in files.collect())
    named = {p.rsplit("/", 1)[-1].rsplit(".", 1)[0].upper(): p for p in paths}
    return {name: spark.read.option("header", True).option("sep", separator).csv(path) for name, path in named.items()}
