import os

import duckdb
import pytest

from tonewright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{os.path.join(small, t)}.parquet'")
    want = c.sql(queries.oracle_sql()[name]).to_arrow_table()
    got = queries.queries()[name](spark, small).toArrow()
    names = sorted(want.column_names)
    assert names == sorted(got.column_names)
    rows = lambda t: sorted(tuple(str(r[c]) for c in names) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_every_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.queries()) == list(range(1, 14))
