"""The entry module, from another folder and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() == 5
assert e.queries()["fnv_simhash"](spark, "/root/testdata/sf0.001").count() == 200
assert set(e.oracle_sql()) <= set(e.queries())
print("llm" if e.llm else "without llm", len(e.queries()))
"""


def run(root, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", CODE.format(root=str(root))], cwd=cwd, env=env, capture_output=True, text=True, timeout=240)


def test_from_another_folder(tmp_path):
    done = run(ROOT, tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("also", ["corpus_pipeline.py", "nothing"])
def test_without_llm(tmp_path, also):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", also, "__pycache__"))
    done = run(copy, tmp_path)
    assert done.returncode == 0 and "without llm" in done.stdout, done.stderr[-2000:]
