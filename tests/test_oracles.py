"""Every registered query against its SQL on the given tables."""

import os

import pytest

from checks import compare, oracles, queries

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES = queries.queries()
SQLS = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.database(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQLS])
def test_same_as_sql(spark, con, name):
    assert compare.difference(spark, con, FOLDER, name, QUERIES[name], SQLS[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQLS])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).collect()


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(QUERIES)
