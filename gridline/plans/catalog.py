"""Queries over the driver tables and the SQL that must give the same rows."""

from __future__ import annotations

from gridline.plans import extract_queries, layout_queries, pdf_queries, reasoned_queries, record_queries, table_queries, text_queries  # noqa: F401 - they register their queries
from gridline.plans.register import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
