"""The driver's contract, and every SQL-checked query of the library against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sedimenta.plans import registry

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"query_id", "path", "score", "rank"}
    assert entry.oracle_sql().keys() <= entry.queries().keys() and registry.QUERIES.keys() <= entry.queries().keys()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).map(lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLE_SQL[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
