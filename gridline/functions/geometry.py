"""Boxes and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes x1, y1, x2, y2; 0 if apart or without area."""
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    common = F.when((wide < 0) | (high < 0), F.lit(0.0)).otherwise(wide * high)
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    union = area(a) + area(b) - common
    return F.when(union <= 0, F.lit(0.0)).otherwise(common / F.when(union > 0, union))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(norm > 0, norm))
