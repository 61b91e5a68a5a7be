"""Every query against its SQL in DuckDB, on the small tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind in "iu":
            df[c] = df[c].astype("int64")
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, sf, name):
    a = canonical(entry.queries()[name](spark, sf).toPandas())
    b = canonical(duck.execute(entry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=True)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"))
def test_rows_only(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 500
