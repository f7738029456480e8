"""Every query of the engine against its SQL on the smallest tables."""

import os
import pathlib
import shutil
import subprocess
import sys

import pytest
from compare import same
from conftest import SF
from pyspark.sql import functions as F

from paperloom.plans import queries
from paperloom.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    same(QUERIES[name](spark, SF), sql, ORACLES[name])


@pytest.mark.parametrize("name", ["image_overlap", "neighbor_clamp"])
def test_boxes_of_one_full_page(spark, sql, name, monkeypatch):
    boxes = queries._boxes
    monkeypatch.setattr(queries, "_boxes", lambda *a: boxes(*a).where("vec_id < 400").withColumn("page", F.floor(F.col("vec_id") / 400)))
    oracle = ORACLES[name].replace("vec_id // 25", "vec_id // 400").replace("FROM embeddings", "FROM embeddings WHERE vec_id < 400")
    got = QUERIES[name](spark, SF)
    same(got, sql, oracle)
    assert got.count() > 25


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [["paperloom/llm", "tests/llm"], ["paperloom/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_module_without_training_operators(tmp_path, gone):
    home, copy = pathlib.Path(__file__).parents[1], tmp_path / "copy"
    shutil.copytree(home, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        if (path := copy / name).is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, n_sql = map(int, said.stdout.split())
    assert n >= len(QUERIES) and n_sql >= len(ORACLES)
    assert n == len(QUERIES) or "paperloom/llm" not in gone
