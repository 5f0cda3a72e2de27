"""Every registered query of the graph engine against its SQL in DuckDB."""

import duckdb
import pytest

from geoloom.plans import catalogue, city_catalogue, tables_catalogue, town_catalogue  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if v is None or isinstance(v, (bool, str)):
        return v
    return round(float(v), 6)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    cur = duck.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    assert got == want
