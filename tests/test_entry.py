"""Every registered query against its SQL twin on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tunedata.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "part events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return None
        return round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, row)) for row in df.itertuples(index=False)), key=repr)


def test_every_plain_query_has_a_twin():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
