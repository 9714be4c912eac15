"""Every registered query against its SQL on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("the given tables are not here")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert compare(spark, con, name, QUERIES[name], SQL[name], SF_DIR) is None
    else:
        assert QUERIES[name](spark, SF_DIR).limit(1).count() == 1


def test_entry(spark, con):
    assert entry.entry(spark).columns == ["metric", "entity", "stat", "rank"]


def test_names():
    assert set(SQL) <= set(QUERIES)
