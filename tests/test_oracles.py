"""Every SQL-checked query equals its DuckDB oracle (as the external check)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_compare import compare, duck

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, n, _, detail = compare(spark, name, E.queries()[name], SQL[name], SF_SMALL, con)
    assert ok, detail
    assert n > 0


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["id_sample", "state"]
    assert len(rows) > 0
