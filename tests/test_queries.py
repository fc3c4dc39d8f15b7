"""Every registered query against its SQL at the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as contract  # noqa: E402
from check import rows_of  # noqa: E402

from logsieve.plans.views import TABLES  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    got = rows_of(df.columns, df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    names = list(duck.sql(sql).columns)
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, duck.execute(sql).fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
