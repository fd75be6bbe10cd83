"""Every registered query against its checking SQL on the smallest tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name, entry.queries()[name], CHECKS.get(name)) is None


def test_checks_name_queries():
    assert set(CHECKS) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["call_id", "verdict", "rule", "cost"]
