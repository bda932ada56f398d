"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import DATA, connect, differences
from fieldglass import workload

QUERIES, SQL = workload.queries(), workload.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, DATA), con, SQL[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 2
