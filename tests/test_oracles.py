"""Every catalogue query against its SQL statement."""

import pytest

import __spark_entry__ as entry
from kerbline.plans import catalog
from tests.oracle_check import compare, connect

QUERIES, SQLS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_equals_sql(spark, con, sf_dir, name):
    problem = compare(spark, con, QUERIES[name], SQLS[name], sf_dir)
    assert problem is None, problem


def test_every_statement_has_a_query():
    assert set(SQLS) <= set(QUERIES)
    assert set(catalog.queries()) <= set(SQLS)


def test_entry(spark):
    assert entry.entry(spark).count() == 6
