"""The cells of the vector index against a scan of all vectors."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from memlattice.api import MemoryStore
from memlattice.operators.retrieval import vector_top_k
from memlattice.operators.vector_cells import ODD, VectorCells

SCHEMA = "id string, v array<float>"


def _vectors(n, groups, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 12))
    return [(f"m{k:04d}", [float(x) for x in centres[k % groups] + 0.05 * rng.normal(size=12)]) for k in range(n)]


def test_cells_find_what_a_scan_finds_and_read_less(spark, tmp_path):
    rows = _vectors(600, 15)
    rows += [("same1", rows[0][1]), ("same2", rows[0][1]), ("zero", [0.0] * 12), ("null", None), ("short", [1.0, 2.0]), ("hole", [None] + [1.0] * 11), ("inf", [math.inf] + [1.0] * 11)]
    df = spark.createDataFrame(rows, SCHEMA)
    cells = VectorCells.build(df, "id", "v", str(tmp_path / "c"))
    facts = {f["cell"]: f["n"] for f in cells.facts()}
    assert sum(facts.values()) == len(rows) - 3 and facts[ODD] == 2  # null, hole and inf are in no cell
    regular = df.filter("id not in ('hole', 'inf')")
    read = []
    for q in (rows[0][1], rows[7][1], [-x for x in rows[3][1]], [1.0] + [0.0] * 11):
        for k in (1, 5, 50):
            found = vector_top_k(cells.rows(chosen := cells.cells_for(q, k)), "id", "vector", q, k).collect()
            want = vector_top_k(regular, "id", "v", q, k).collect()
            assert [(r.id, round(r.score, 6)) for r in found] == [(r.id, round(r.score, 6)) for r in want]
            read.append(sum(facts[c] for c in chosen) / len(rows))
    assert read[0] < 0.35 and len(cells.cells_for(rows[0][1], 10_000)) == len(facts)
    plan = cells.rows(cells.cells_for(rows[0][1], 5))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_cells_of_few_vectors(spark, tmp_path):
    for n in (0, 1, 2):
        df = spark.createDataFrame([(f"m{k}", [1.0, float(k)]) for k in range(n)], SCHEMA)
        cells = VectorCells.build(df, "id", "v", str(tmp_path / str(n)))
        assert [r.id for r in cells.top_k([1.0, 0.0], 3).collect()] == [f"m{k}" for k in range(n)]
    only = spark.createDataFrame([("z", [0.0, 0.0])], SCHEMA)
    assert VectorCells.build(only, "id", "v", str(tmp_path / "z")).top_k([1.0, 0.0], 3).select("id", F.col("score") == 0).first() == ("z", True)


def test_a_store_searches_its_cells_until_the_vectors_change(spark, tmp_path):
    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(t.count(c)) for c in "abc"])

    store = MemoryStore(spark, str(tmp_path / "s"), embed=embed)
    store.remember([{"id": f"m{k}", "judgment": "a" * k + "b" * (9 - k)} for k in range(10)])
    store.follow()
    nearest = lambda: [(r.id, round(r.score, 6)) for r in store._nearest("aab", 3).collect()]
    scanned = nearest()
    state = store.cluster_vectors(3)
    assert store._cells_at(state) is not None and nearest() == scanned and store.cluster_vectors(3) == state
    store.remember([{"id": "new", "judgment": "aab"}])
    assert store._cells_at(store.tables.state()) is None and ("new", 1.0) in nearest()
    store.cluster_vectors(3)
    assert store._cells_at(store.tables.state()) is not None and ("new", 1.0) in nearest()


def test_a_vector_is_in_the_nearest_cell_and_a_cell_in_one_part(spark, tmp_path):
    rows = _vectors(300, 9) + [("zero", [0.0] * 8), ("short", [1.0]), ("none", None)]
    cells = VectorCells.build(spark.createDataFrame(rows, "id string, vector array<double>").repartition(4), "id", "vector", str(tmp_path), cells=9)
    centre = {f["cell"]: f["centre"] for f in cells.facts() if f["cell"] >= 0}
    stored = cells.rows([f["cell"] for f in cells.facts()])
    held = {r.id: (r.vector, r.cell) for r in stored.collect()}
    assert len(held) == 302 and held["zero"][1] == held["short"][1] == -1
    for v, cell in (x for x in held.values() if x[1] >= 0):
        angle = {c: math.acos(max(-1.0, min(1.0, sum(a * b for a, b in zip(v, p)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in p))))) for c, p in centre.items()}
        assert angle[cell] <= min(angle.values()) + 1e-7
    assert len(stored.inputFiles()) == len(cells.facts())
