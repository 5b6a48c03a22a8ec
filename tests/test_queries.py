"""Every registered query with an oracle equals it on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def shown(value):
    if hasattr(value, "__iter__") and not isinstance(value, str):
        return str(list(value))
    if value is None or pd.isna(value):
        return "null"
    return str(value) if isinstance(value, (str, bool)) or type(value).__name__ == "bool_" else repr(float(value))


def rows_of(frame):
    return sorted(tuple(shown(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    ours, theirs = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) >= 60
