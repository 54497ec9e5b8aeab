"""Every registered query runs at the smallest size and agrees with its SQL where it has one."""

import os

import duckdb
import pandas as pd
import pytest

from quillon.plans import all_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(value):
    if value is None or value is pd.NA or value != value:
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6)).removesuffix(".0")
    return str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query(spark, duck, name):
    df = all_queries.QUERIES[name](spark, SF)
    if name not in all_queries.ORACLES:
        assert df.count() > 0
        return
    assert rows(df.toPandas()) == rows(duck.execute(all_queries.ORACLES[name]).df())
