"""Every catalog query with a SQL oracle agrees with DuckDB on sf0.001."""

import os

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["month", "monthly_cost", "monthly_delay"]
    assert df.count() > 0
