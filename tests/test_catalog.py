"""Every registered query against its SQL, on the middle-sized tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quaverline.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns, key=lambda c: (df[c].dtype == float, c))
    return df[columns].sort_values(columns, ignore_index=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = ordered(catalog.QUERIES[name](spark, SF).toPandas()), ordered(duck.execute(catalog.ORACLE[name]).df())
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    for c in got.columns:
        if got[c].dtype == float:
            assert (got[c] - want[c]).abs().max() <= 1.5e-6, c
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_kernel_queries_run(spark, name):
    rows = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    assert len(rows) > 0 and not rows.isna().any().any()
