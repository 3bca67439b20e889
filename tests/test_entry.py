"""The engine stands without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

CODE = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
found = entry.queries()
assert set(entry.oracle_sql()) <= set(found) and "hybrid_search" in found
assert not [n for n in found if n.startswith("op") and n[2].isdigit()] and "pipeline" not in found
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert found["dedup_counts"](spark, "/root/testdata/sf0.001").count() == 1
"""


@pytest.mark.parametrize("gone", [("lodestone/llm", "tests/llm", "corpus_pipeline.py"), ("lodestone/llm", "tests/llm")])
def test_without_llm(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    run = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]


def test_missing_library(tmp_path):
    (tmp_path / "zstandard.py").write_text("raise ImportError('none')")
    code = "import __spark_entry__ as e; assert 'hybrid_search' in e.queries() and 'op4_suffix_dedup' not in e.queries()"
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={"PYTHONPATH": f"{tmp_path}:{ROOT}", "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
