"""Every registered query against its SQL twin."""

import pytest

from fleetcheck import catalog, oracles
from tests.oracle_check import compare, duck

QUERIES = catalog.queries()
TWINS = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck("/root/testdata/sf0.001")


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    assert compare(con, QUERIES[name](spark, sf_dir), TWINS[name]) is None


def test_entry(spark):
    import __spark_entry__ as contract
    frame = contract.entry(spark)
    assert frame.count() > 0
    assert set(QUERIES) <= set(contract.queries())
    assert set(TWINS) <= set(contract.oracle_sql()) <= set(contract.queries())
