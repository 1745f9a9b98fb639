"""Every registered query against its SQL, on the smallest given tables."""

import os

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, db, name):
    ok, note = compare(spark, db, queries()[name], oracle_sql()[name], SF_DIR)
    assert ok, note


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
