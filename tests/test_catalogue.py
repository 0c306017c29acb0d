"""Each query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lodestar import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name not in catalogue.ORACLE_SQL:
        return
    want = duck.sql(catalogue.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    keys = sorted(cols, key=lambda c: got[c].dtype == "float64")
    got, want = (x[cols].sort_values(keys).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1.1e-6)


def test_entry(spark):
    assert entry.entry(spark).count()


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
