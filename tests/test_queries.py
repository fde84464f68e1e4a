"""Every registered query against its SQL, on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registered

SF_DIR = "/root/testdata/sf0.001"
# The corpus operators have their own tests; their subpackage may be absent.
QUERIES = {name: query for name, query in registered.queries().items() if name in registered.QUERIES}
ORACLE = {name: sql for name, sql in registered.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF_DIR}/{file}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, database, name):
    found = QUERIES[name](spark, SF_DIR)
    wanted = database.sql(ORACLE[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    assert rows
    expected = wanted.project(", ".join(columns)).fetchall()
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize(("name", "most"), [("audio_tags", 8), ("narration_select", 4), ("title_uniform", 2), ("title_report", 2)])
def test_plan_reads_each_table_about_once(spark, name, most):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= most
