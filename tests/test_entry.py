"""The registry with and without the folders that may be taken away."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_import_without_the_llm_folders(tmp_path):
    shutil.copytree(f"{ROOT}/memlattice", tmp_path / "memlattice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry_has_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["id", "similarity"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_plans(spark):
    """What the scans read and where rows are exchanged."""
    from memlattice.plans.queries import QUERIES

    plan = lambda name: QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    decay = plan("t0_decay")
    # one broadcast of the small labels table and no other exchange; unused columns are not read
    assert "SortMergeJoin" not in decay and "n_chars" not in decay and "hashpartitioning" not in decay
    assert "TakeOrderedAndProject" in plan("vector_topk")
    assert "PushedFilters: [IsNotNull(label)]" in plan("per_file_cap")
    assert "WindowGroupLimit" in plan("capacity_evict") or "Window" in plan("capacity_evict")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_memory_actions_takes_every_event(spark):
    import __spark_entry__ as e

    creates = spark.read.parquet(f"{DATA}/events.parquet").filter("event_id % 3 = 2").selectExpr("'merged ' || event_id as judgment")
    assert creates.filter("cast(substr(judgment, 8) as long) >= 400").count() > 0
    got = e.queries()["memory_actions"](spark, DATA).select("judgment")
    assert creates.exceptAll(got).count() == 0
