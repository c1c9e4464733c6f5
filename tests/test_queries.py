"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

from cairn.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    rows = QUERIES[name](spark, sf)
    got = sorted((tuple(plain(r[c]) for c in sorted(rows.columns)) for r in rows.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    result = duck.sql(ORACLE_SQL[name])
    at = [result.columns.index(c) for c in sorted(result.columns)]
    assert sorted(result.columns) == sorted(rows.columns)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
