"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from cellwave.workload import all_queries, all_sql

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    rows, problems = compare(spark, con, FOLDER, QUERIES[name], SQL[name])
    assert rows > 0
    assert not problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1


def test_sql_keys_are_queries():
    assert set(SQL) <= set(QUERIES)
