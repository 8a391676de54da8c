"""Every registered query against its DuckDB statement, on the smallest data set."""

import __spark_entry__ as entry
import pytest

from checks.compare import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, con, name):
    status, _, _ = compare(spark, sf, con, QUERIES[name], ORACLES.get(name))
    assert status in ("ok", "rows-only"), status


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_statements_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
