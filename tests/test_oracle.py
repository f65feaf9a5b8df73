"""Every query of the library against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tagloom import catalogue

SF = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return ""
        return repr(round(x, 6)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, tables, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), tables.execute(catalogue.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
