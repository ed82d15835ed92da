"""Every registered query of the engine's own operators against its SQL, and a run of those without."""

import os
import shutil
import subprocess
import sys

import pytest

from gridloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(name, spark, duck, sf_dir, same):
    same(catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5 * 64
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_llm(tmp_path, pipeline):
    """The rest imports and registers its queries when the llm folders are gone, with or without the pipeline's file."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "gridloom"), tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0 and done.stdout.split() == [str(len(catalog.QUERIES)), "False"], done.stderr
