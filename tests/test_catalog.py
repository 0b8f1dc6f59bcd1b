"""Every query of the catalogue against its SQL twin."""

import math

import duckdb
import pytest

from tickloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def cell(v):
    return "null" if v is None else ("nan" if math.isnan(v) else repr(round(v, 6) + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    frame = catalog.queries()[name](spark, sf)
    names = sorted(frame.columns)
    mine = sorted(tuple(cell(r[n]) for n in names) for r in frame.collect())
    found = duck.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    assert mine == sorted(tuple(cell(r[i]) for i in at) for r in found.fetchall())
    spark.catalog.clearCache()


def test_every_query_has_a_twin():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
