"""Each operator's query against its SQL."""

import os

import duckdb
import pytest
from edgeloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def views(sf_dir):
    db = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        db.sql(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, views, name):
    got, want = QUERIES[name](spark, sf_dir), views.sql(ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(want.select(*order).fetchall())
