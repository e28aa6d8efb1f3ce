"""Every query with an SQL twin gives the twin's rows; every other one runs."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tallyforge.plans import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracles()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(frame):
    """Rows with columns by name, numbers to six digits, in a fixed order."""

    def value(x):
        if x is None or (not isinstance(x, (str, list)) and pd.isna(x)):
            return "null"
        if isinstance(x, (bool, str)):
            return str(x)
        return f"{float(x) + 0.0:.6g}"

    cols = sorted(frame.columns)
    return cols, sorted(tuple(value(x) for x in row) for row in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_of_the_twin(spark, duck, name):
    assert normal(QUERIES[name](spark, FOLDER).toPandas()) == normal(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() >= 1 and df.columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
