"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from prosewright.plans import queries as plans

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def shown(frame):
    def one(v):
        if pd.isna(v):
            return ""
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(one(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_says_what_its_sql_says(spark, duck, name):
    assert shown(plans.QUERIES[name](spark, DIR).toPandas()) == shown(duck.execute(plans.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_runs(spark, name):
    frame = plans.QUERIES[name](spark, DIR)
    assert len(frame.columns) > 1
    frame.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
