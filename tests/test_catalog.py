"""Every query of the catalog against its SQL in another engine."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from gleaner.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def other(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v: object) -> str:
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "-"
        return f"{float(v):.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, other, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    want = other.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    floats = [c for c in got.columns if got[c].dtype.kind == "f" or want[c].dtype.kind == "f"]
    assert plain(got.astype(dict.fromkeys(floats, "float64"))) == plain(want.astype(dict.fromkeys(floats, "float64")))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert not set(__spark_entry__.oracle_sql()) - set(__spark_entry__.queries())
