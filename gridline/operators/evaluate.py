"""Scores of predicted records against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridline.functions.text import strip


def field_score(predicted: Column, expected: Column) -> Column:
    """1 for equal texts (case and outer spaces aside), 0.5 if one holds the other, else 0. Null is empty."""
    p, e = (strip(F.lower(F.coalesce(c, F.lit("")))) for c in (predicted, expected))
    return F.when(p == e, 1.0).when(F.contains(p, e) | F.contains(e, p), 0.5).otherwise(0.0)


def accuracy(predicted: Column, expected: Column) -> Column:
    """Mean field score over the keys of expected (maps); 0 if either is empty or null."""
    scores = F.transform(F.map_keys(expected), lambda k: field_score(F.try_element_at(predicted, k), F.try_element_at(expected, k)))
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s)
    some = (F.size(F.map_keys(expected)) > 0) & (F.size(F.map_keys(predicted)) > 0)
    return F.coalesce(F.when(some, total / F.greatest(F.size(scores), F.lit(1))), F.lit(0.0))


def summary(results: DataFrame, by: str = "mode") -> DataFrame:
    """by, n, mean, best, worst of results(by, accuracy); failures count as 0."""
    score = F.coalesce("accuracy", F.lit(0.0))
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), F.max(score).alias("best"), F.min(score).alias("worst"))


def best(results: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The n results of highest accuracy, ties by order: a top-n without a sort of all."""
    return results.orderBy(F.desc("accuracy"), *order).limit(n)


FIELDS = ["name", "unit", "quantity", "spec"]


def cases_of_columns(rows: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """input, expected struct<simplified, extended> from flat columns such as simplified_name.

    Missing columns and nulls are empty; units default to `шт.`.
    """
    defaults = defaults or {"unit": "шт."}
    columns = set(rows.columns)

    def value(mode: str, name: str) -> Column:
        column = F.col(f"{mode}_{name}").cast("string") if f"{mode}_{name}" in columns else F.lit(None).cast("string")
        return F.coalesce(F.nullif(column, F.lit("")), F.lit(defaults.get(name, ""))).alias(name)

    simplified = F.struct(*[value("simplified", n) for n in FIELDS])
    extended = F.struct(*[value("extended", n) for n in ["denotation", "manufacturer", *FIELDS]])
    return rows.select(F.coalesce("input", F.lit("")).alias("input"), F.struct(simplified.alias("simplified"), extended.alias("extended")).alias("expected"))


def scored(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, accuracy, error of every expected record; one that wasn't predicted scores 0.

    predicted: keys, predicted map, error; expected: keys, expected map.
    """
    joined = expected.join(predicted, keys, "left")
    score = F.when(F.col("error").isNull(), accuracy(F.col("predicted"), F.col("expected"))).otherwise(0.0)
    return joined.select(*keys, score.alias("accuracy"), "error")
