"""Every query with a SQL twin gives the same rows in Spark and DuckDB."""

import datetime

import duckdb
import pytest

from tesserae.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return float(v) if type(v).__name__ == "Decimal" else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    out = catalog.queries()[name](spark, sf)
    got = out.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(out.columns) == sorted(want.columns)
    assert rows(out.columns, [tuple(r) for r in got]) == rows(want.columns, want.fetchall())
