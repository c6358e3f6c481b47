"""Registered queries against their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import registry
from check_queries import compare, oracle_connection

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, connection, name):
    ok, message = compare(spark, connection, name, FOLDER)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
