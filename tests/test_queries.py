"""Every registered query against its DuckDB counterpart on the smallest data."""

import pytest
from compare import check
from conftest import SMALL

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 240


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message, _, n = check(spark, con, SMALL, name, QUERIES[name], ORACLES.get(name))
    assert ok, message
    assert n or name in ORACLES, "no rows and nothing to compare them with"
