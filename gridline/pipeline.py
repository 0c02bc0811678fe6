"""From files to mapped records, end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridline.model import HEADER_ANCHORS
from gridline.operators import mapping, tables
from gridline.session import cut
from gridline.sources.files import read_files

KEYS = ["path", "table_id"]


def clean_tables(rows: DataFrame, anchors: dict[str, list[str]] = HEADER_ANCHORS) -> DataFrame:
    """path, table_id, row_idx, rec of all tables: trimmed to their header, cleaned, named.

    Tables without a header have numbered names and keep their first row.
    """
    found = rows.where("status = 'ok'").select(*KEYS, "row_idx", "cells")
    headers = tables.header_rows(found, KEYS, anchors)
    cleaned = tables.clean_cells(tables.to_cells(tables.from_header(found, headers, KEYS), KEYS), KEYS)
    lines = cleaned.groupBy(*KEYS, "row_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "text"))), lambda c: c["text"]).alias("cells"))
    has = headers.select(*KEYS, F.col("header_idx").isNotNull().alias("_has"))
    heads = lines.where("row_idx = 0").join(has, KEYS, "left")
    names = heads.select(*KEYS, "_has", F.when(F.col("_has"), tables.header_names(F.col("cells"))).otherwise(tables.numbered_names(F.size("cells"))).alias("_names"))
    body = lines.join(names, KEYS).where(~F.col("_has") | (F.col("row_idx") > 0)).withColumn("row_idx", F.col("row_idx") - F.col("_has").cast("int"))
    return tables.records(body, KEYS, F.col("_names"))


def process(files: DataFrame, model: Callable[[list[str]], list[str | None]], extended: bool = True) -> tuple[DataFrame, DataFrame]:
    """Mapped rows of all files, and a status for each file.

    files(path, content); model answers prompts with JSON. A broken file or a
    failed chunk is a row with its error and stops nothing else. Files are
    decoded once: their rows are kept in the checkpoint folder, and tables and
    statuses read those.
    """
    rows = cut(read_files(files))
    mapped = mapping.map_records(clean_tables(rows), KEYS, model, extended)
    return mapped, rows.select("path", "status", "error").distinct()
