"""Queries against their SQL, and what is registered."""

import re

import pytest
from checks import compare

from tabgauge.llm import registered

FOLDER = "/root/testdata/sf0.001"
SQLS = registered.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQLS))
def test_same_as_sql(spark, name):
    con = compare.database(FOLDER)
    query = registered.queries()[name]
    assert compare.difference(spark, con, FOLDER, name, query, SQLS[name]) is None


def test_one_query_per_operator_and_the_pipeline():
    names = list(registered.queries())
    assert [int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))] == list(range(1, 14))
    assert names[-1] == "pipeline" and set(SQLS) <= set(names)
