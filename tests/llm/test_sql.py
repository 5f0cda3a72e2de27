"""Queries of this subpackage that SQL can express, against DuckDB on whole tables."""

import duckdb
import pytest

from geoloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cur = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(([r[cols.index(c)] for c in sorted(cols)] for r in cur.fetchall()), key=repr)
    assert sorted(([r[c] for c in sorted(cols)] for r in df.collect()), key=repr) == want
