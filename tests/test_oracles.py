"""Every query with an oracle gives the same rows as DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from gridline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def rows(table, names):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(plain(r[n]) for n in names) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(columns) == names
    got = [r.asDict() for r in df.collect()]
    assert rows(got, names) == rows(want, names)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_oracle(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
