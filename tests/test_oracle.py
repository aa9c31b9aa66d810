"""Every registered query against its SQL on the smallest driver tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.check_oracle import duck, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    columns, got = spark_rows(QUERIES[name](spark, SF))
    want_columns, want = duck_rows(con, ORACLES[name])
    assert columns == want_columns
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
