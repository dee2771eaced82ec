"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import pathlib

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    found = difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert found is None, found


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).count() > 0
    for name in ("enriched_flights",):
        assert name not in sql and queries[name](spark, SF).count() > 0
