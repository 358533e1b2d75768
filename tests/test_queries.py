"""Every registered query runs on the sf0.001 tables; every oracle query matches DuckDB."""
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
SLOW = {"train_best"}


def _canon(df):
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        row = []
        for v in rec:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
                v = None
            elif isinstance(v, pd.Timestamp):
                v = v.to_pydatetime()
            elif hasattr(v, "tolist"):
                v = v.tolist()
                v = str(v) if isinstance(v, (list, dict)) else v
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                v = float(v)
            row.append(v)
        rows.append(tuple(row))
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "aqi" in df.columns


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle(spark, con, name):
    got = _canon(E.queries()[name](spark, SF).toPandas())
    exp = _canon(con.sql(E.oracle_sql()[name]).df())
    assert got[0] == exp[0]
    assert got[1] == exp[1]


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql()) - SLOW))
def test_rows_only(spark, name):
    assert E.queries()[name](spark, SF).count() >= 0
