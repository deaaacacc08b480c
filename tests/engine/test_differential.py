"""Every catalogued query against its SQL twin in DuckDB, over the same files."""

import os

import duckdb
import pytest

from tonewright import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(table):
    names = sorted(table.column_names)
    said = lambda x: "~" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x)
    return names, sorted(tuple(said(r[c]) for c in names) for r in table.to_pylist())


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, small, duck, name):
    got = rows_of(plans.queries()[name](spark, small).toArrow())
    assert got == rows_of(duck.sql(plans.oracle_sql()[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows_only(spark, name):
    found = plans.queries()[name](spark, os.environ.get("TEST_MODEL_DIR", "/root/testdata/sf0.01"))
    assert found.count() > 0
