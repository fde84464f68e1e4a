"""Registered corpus queries against their SQL."""

import os

import duckdb
import pytest

from lectern.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name, folder):
    path = f"/root/testdata/{folder}"
    database = duckdb.connect()
    for file in os.listdir(path):
        database.execute(f"create view {file.removesuffix('.parquet')} as select * from '{path}/{file}'")
    found, wanted = QUERIES[name](spark, path), database.sql(ORACLE[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in found.collect())
    assert rows == sorted(map(str, wanted.project(", ".join(columns)).fetchall()))
