import subprocess
import sys

from tests.conftest import ROOT


def test_entry_works_without_the_training_data_subpackage(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'candidate_union' in names and not any(n.startswith('op') for n in names); assert set(e.oracle_sql()) <= names"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark)
    assert rows.columns[0] == "key" and rows.count() > 0
