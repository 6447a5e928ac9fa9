"""Every query with SQL against DuckDB on the smallest tables."""

import pytest
from check_oracles import compare, duck
from conftest import DATA

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, DATA) == ""
