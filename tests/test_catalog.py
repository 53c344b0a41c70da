"""Every registered query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import canonical

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_imports_without_the_text_operators(tmp_path):
    """As the driver does: a copy without those folders, with and without the pipeline's module, in a process of its own."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "skeinwatch", tmp_path / "skeinwatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1_') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    for with_pipeline in (False, True):
        if with_pipeline:
            shutil.copy(here / "corpus_pipeline.py", tmp_path)
        done = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        n, *rest = done.stdout.split()
        assert int(n) > 100 and rest == ["False", "False", "True"]
