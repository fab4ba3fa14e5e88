"""The registered queries against their SQL, and the entry without the optional part."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from quadloom.more_queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def database(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, database, name):
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = QUERIES[name].run(spark, data)
    want = database.sql(QUERIES[name].sql)
    columns = list(want.columns)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(map(shown, r)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_optional_part(tmp_path):
    """The operators' folder, their tests and the pipeline taken out: the other queries are all there."""
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(root)})
    assert out.stdout.split() == ["True", str(len(QUERIES))], out.stderr
