"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect
from runquarry.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    message, same = compare(spark, duck, SF, name, QUERIES[name], ORACLES.get(name))
    assert same, message


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
