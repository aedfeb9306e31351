"""Every query with SQL returns what DuckDB returns for it."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def normal(frame):
    def value(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return None
        return float(f"{x:.12g}") if isinstance(x, float) else x.item() if hasattr(x, "item") else x

    columns = sorted(frame.columns)
    return columns, sorted(repr([value(x) for x in row]) for row in frame[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n in entry.queries()))
def test_query_equals_sql(spark, duck, name):
    assert normal(entry.queries()[name](spark, SMALL).toPandas()) == normal(duck.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() == 1
