"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import DATA, compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duckdb_tables():
    if not os.path.isdir(f"{DATA}/sf0.001"):
        pytest.skip("no test tables")
    return duck("0.001")


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duckdb_tables, name):
    problem, _ = compare(spark, duckdb_tables, "0.001", QUERIES[name], ORACLES.get(name))
    assert problem is None, problem
