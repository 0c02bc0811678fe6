"""Mapping of records to a target schema by a pluggable model."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridline.functions import text as X
from gridline.model import EXTENDED, SIMPLIFIED, response
from gridline.operators.tables import chunks


def json_schema(columns: list[str], name: str = "TableRow") -> dict:
    """The JSON schema of a model's answer."""
    fields = {c: {"title": c, "type": "string", "default": ""} for c in columns}
    rows = {"title": "Rows", "type": "array", "items": {"$ref": f"#/$defs/{name}"}}
    return {"$defs": {name: {"title": name, "type": "object", "properties": fields}}, "title": "StructuredOutput", "type": "object", "properties": {"rows": rows}, "required": ["rows"]}


def retryable(error: Exception) -> bool:
    """False where another try can't help: the account's limit is used up."""
    return "rate_limit_exceeded" not in str(error)


def ask(prompts: DataFrame, model: Callable[[list[str]], list[str | None]], attempts: int = 3, wait: float = 0.0, longest: float = 60.0) -> DataFrame:
    """prompts with answer and error; model answers a batch of prompts.

    A batch that fails is tried again after wait seconds, doubled each time up
    to longest; then its rows carry the error and the others go on.
    """

    def run(batches):
        for pdf in batches:
            answers, error = [None] * len(pdf), None
            for n in range(attempts):
                try:
                    answers, error = model(pdf["prompt"].tolist()), None
                    break
                except Exception as e:  # noqa: BLE001 - any failure of a model is reported in its rows
                    error = str(e)
                    if not retryable(e):
                        break
                    if wait and n + 1 < attempts:
                        time.sleep(min(longest, wait * 2**n))
            yield pdf.assign(answer=pd.Series(answers, index=pdf.index, dtype=object), error=pd.Series([error] * len(pdf), index=pdf.index, dtype=object))

    schema = T.StructType([*prompts.schema, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])
    return prompts.mapInPandas(run, schema)


def answer_rows(answer: Column, columns: list[str]) -> Column:
    """The rows of an answer (array<struct>), code fence and talk before it aside; null if it isn't JSON."""
    return F.from_json(X.unfenced(F.trim(answer)), response(columns))["rows"]


def map_records(
    records: DataFrame,
    keys: list[str],
    model: Callable[[list[str]], list[str | None]],
    extended: bool = True,
    size: int = 5,
    wrap: Callable[[Column], Column] | None = None,
    cut: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """keys, chunk_idx, pos and the target columns of every mapped row; a failed chunk gives one row with error.

    Missing fields are empty, unknown ones are ignored. wrap makes the whole
    prompt out of a chunk's text, cut the answer out of what the model says.
    """
    columns = EXTENDED if extended else SIMPLIFIED
    asked = chunks(records, keys, size)
    answered = ask(asked.withColumn("prompt", wrap(F.col("prompt"))) if wrap else asked, model)
    parsed = answered.withColumn("_rows", answer_rows(cut(F.col("answer")) if cut else F.col("answer"), columns))
    error = F.coalesce("error", F.when(F.col("_rows").isNull(), F.lit("not the JSON asked for")))
    rows = parsed.withColumn("error", error).select(*keys, "chunk_idx", "error", F.posexplode_outer("_rows").alias("pos", "_r"))
    return rows.select(*keys, "chunk_idx", F.coalesce("pos", F.lit(0)).alias("pos"), *[F.coalesce(F.col("_r")[c], F.lit("")).alias(c) for c in columns], "error")
