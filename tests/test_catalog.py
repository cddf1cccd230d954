"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tracewarden.plans import catalog


def rows(d):
    d = d[sorted(d.columns)].astype(object)

    def text(v):
        if isinstance(v, list | np.ndarray):
            return str(list(v))
        if v is None or v is pd.NaT or v != v:
            return "~"
        return str(int(v)) if isinstance(v, bool | np.bool_) else f"{v:.9g}" if isinstance(v, float | np.floating) else str(v)

    return sorted("|".join(map(text, r)) for r in d.itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, sf, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
