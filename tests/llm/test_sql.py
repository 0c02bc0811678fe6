"""Queries of the subpackage give the same rows as their DuckDB text."""

import math

import duckdb
import pytest

from gridline.llm import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = sorted(d[0] for d in cursor.description)
    place = [[d[0] for d in cursor.description].index(c) for c in columns]
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in cursor.fetchall()), key=repr) and got
