"""Each query against its SQL, and the entry points without the pipeline operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__
import duckdb
import pytest
from edgeloom import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def views(sf_dir):
    db = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        db.sql(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return db


def canonical(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row)) for row in rows)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) & set(queries.ORACLE_SQL)))
def test_query_against_sql(spark, sf_dir, views, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = views.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert canonical(got.select(*order).collect()) == canonical(want.select(*order).fetchall())


def test_other_queries_run(spark, sf_dir):
    from edgeloom.functions.paths import normalize

    assert all(r.path == normalize(r.raw) for r in queries.QUERIES["path_normalize"](spark, sf_dir).collect())


def test_places_of_edges_are_unique(spark, sf_dir):
    from edgeloom.plans import derive

    for sql in (derive.FOREIGN_KEYS, derive.EVENTS, derive.PATHS):
        edges = derive.graph(spark, sf_dir, sql)
        assert edges.select("ord").distinct().count() == edges.count()
    assert 17 * derive.SPACE + (200 * 6_000_000 * 10 + 7) * derive.WIDTH + derive.WIDTH < 1 << 63 and (200 * 6_000_000 * 10 + 7) * derive.WIDTH < derive.SPACE


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 1000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_everything_else_works_without_the_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'impact_edges' in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
