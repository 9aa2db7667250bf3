"""Every query of the catalog against its SQL, or for rows and invariants, at the smallest size."""

import math
import os

import duckdb
import pytest

from plumbline.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
#: Queries that loop or draw pages; one run of each is enough, in its own test below.
HEAVY = {"gr01_flood_select_wide", "ras33_vector_rooms"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k in ORACLES and k not in HEAVY))
def test_against_sql(spark, sf, db, name):
    got = QUERIES[name](spark, sf)
    rel = db.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k not in ORACLES and k not in HEAVY))
def test_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
