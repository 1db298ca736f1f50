"""Every query with SQL gives DuckDB's rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from scriptorium.plans import queries


def normal(df):
    df = df[sorted(df.columns)].copy()

    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "~"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.9g}" if isinstance(v, (int, float, np.number)) else str(v)

    for c in df.columns:
        df[c] = df[c].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def duck(sf):
    connection = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    ours, theirs = normal(queries.QUERIES[name](spark, sf).toPandas()), normal(duck.execute(queries.SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    pd.testing.assert_frame_equal(ours, theirs)
