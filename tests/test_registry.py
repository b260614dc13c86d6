"""The registered queries against their SQL on the smallest data, and the entry point."""

import pytest
from conftest import SF

import __spark_entry__ as entry
from catalog.queries import QUERIES
from check import compare, connect


@pytest.fixture(scope="module")
def con():
    connection = connect(SF)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, SF, name).startswith("ok")
