"""Every registered query with an oracle agrees with DuckDB on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tests.oracle_harness import compare, duck

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["model", "type", "n", "wmae", "rmse", "mae", "r2"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, QUERIES[name], SQL[name], SF001)
    assert ok, msg
