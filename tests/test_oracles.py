"""Every registered query against its SQL in DuckDB on the given tables."""

import glob
import os

import duckdb
import pytest

from voxelloom.plans.all_queries import CHECKS, QUERIES

TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(name, spark, sf_dir, duck):
    result = QUERIES[name](spark, sf_dir)
    columns = sorted(result.columns)
    relation = duck.execute(CHECKS[name])
    described = [d[0] for d in relation.description]
    assert sorted(described) == columns
    assert {d[0]: str(d[1]) for d in relation.description} == {c: TYPES[t] for c, t in result.dtypes}
    expected = [tuple(row[described.index(c)] for c in columns) for row in relation.fetchall()]
    actual = [tuple(row[c] for c in columns) for row in result.collect()]
    assert len(actual) == len(expected)
    assert sorted(actual, key=repr) == sorted(expected, key=repr)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
