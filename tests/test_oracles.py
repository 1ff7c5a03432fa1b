"""Every named query against its SQL on the smallest tables."""

import pytest
from compare import SMALLEST, compare, database

import __spark_entry__ as contract
from cellgrid.registry.oracles import ORACLES
from cellgrid.registry.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return database(SMALLEST)


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, con, name):
    diff, rows, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SMALLEST)
    assert diff is None, diff
    assert rows > 0


def test_oracles_belong_to_queries():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) - set(ORACLES) == {"list_granules", "limiter_state_bound"}


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns[0] == "request_id" and out.count() > 25
