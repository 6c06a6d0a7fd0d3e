"""JSON snapshots against the json module, cut into splits of every size."""

import json
import re

import pytest

from memlattice.sources import files, snapshots

TEXTS = ['plain', 'brace } and { in text', 'quote \\" } "', '\\', '\\\\}', '"records":[{', '中文 } 😀 {', 'line\nend', '', '],"memories":[{"id":"no"}]', 'x' * 3000 + '}' * 50]


def _records(n: int) -> list[dict]:
    return [{"id": f"m{k}", "judgment": TEXTS[k % len(TEXTS)], "reasoning": TEXTS[(k * 7 + 3) % len(TEXTS)], "tags": [TEXTS[(k + j) % len(TEXTS)] for j in range(k % 4)], "strength": k, "is_active": k % 3 == 0} for k in range(n)]


def _shapes(rows: list[dict]) -> dict[str, tuple[object, list[dict]]]:
    other = [{"id": "t1", "name": "records"}, {"id": "t2", "name": "x", "records": [{"id": "deep"}]}]
    return {
        "list": (rows, rows),
        "records": ({"schema_version": 1, "meta": {"a": {"records": [{"id": "no"}]}}, "note": "memories", "records": rows, "global_tags": other, "memory_tag_rel": [{"id": "no"}]}, rows),
        "memories": ({"global_tags": other, "memories": rows, "n": [1, [2, {"id": "no"}]]}, rows),
        "both": ({"memories": other, "records": rows}, rows),
        "both_empty": ({"records": [], "memories": other}, []),
        "null_records": ({"records": None, "memories": rows}, rows),
        "no_records": ({"global_tags": other}, []),
        "empty_list": ([], []),
        "nested": ({"records": [r | {"extra": {"records": [{"id": "inner"}], "memories": []}} for r in rows]}, rows),
    }


@pytest.mark.parametrize(("split", "indent"), [("128m", None), ("1000", 2), ("300", None)])
def test_shapes_and_splits(spark, tmp_path, split, indent):
    """All shapes in one folder; the ids tell which file a record came from."""
    want, names = [], _shapes([])
    for name in names:
        rows = [r | {"id": f"{name}{r['strength']}"} for r in _records(13)]
        document, expected = _shapes(rows)[name]
        (tmp_path / f"{name}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=name == "list"))
        want += [(r["id"], r["judgment"], r["reasoning"], r["tags"], r["strength"], r["is_active"]) for r in expected]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = [(r.id, r.judgment, r.reasoning, r.tags, r.strength, r.is_active) for r in snapshots.read_snapshot(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(found) == sorted(want) and len(want) == 13 * 6


def test_written_snapshots(spark, tmp_path):
    rows = spark.createDataFrame(_records(60), "id string, judgment string, reasoning string, tags array<string>, strength int, is_active boolean")
    tags = spark.createDataFrame([(1, "a"), (2, "records")], "id long, name string")
    path = tmp_path / "out"
    snapshots.write_snapshot({"records": rows, "global_tags": tags}, str(path), 7)
    documents = [json.loads(p.read_text()) for p in path.glob("bucket=*/*.txt")]
    assert len(documents) == 7 and sum(len(x["records"]) for x in documents) == 60 and sum(len(x["global_tags"]) for x in documents) == 2
    back = snapshots.read_snapshot(spark, str(path)).select(*rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    snapshots.write_snapshot({"records": rows.limit(0)}, str(tmp_path / "none"), 2)
    assert snapshots.read_snapshot(spark, str(tmp_path / "none")).count() == 0
    assert files.preview_backup(spark, str(path)).select("records", "active").first() == (60, 20)


def test_pieces_stay_in_place_until_records_meet(spark, tmp_path):
    records = [{"id": f"r{i}", "judgment": f"{{ \\ \" }}] {'x' * (i % 40)}", "tags": ["memories", "records", "[{"], "strength": i, "other": {"a": [{"b": i}]}} for i in range(300)]
    (tmp_path / "s").mkdir()
    for k in range(3):
        (tmp_path / "s" / f"{k}.json").write_text(json.dumps({"tags": [{"id": "no", "x": {}}], "records": records[k::3], "end": {"id": "no"}}))
    (tmp_path / "s" / "bare.json").write_text(json.dumps([{"id": "bare", "tags": []}]))
    settings = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        read = snapshots.read_snapshot(spark, str(tmp_path / "s"))
        got = {r.id: (r.judgment, r.tags, r.strength) for r in read.collect()}
        plan = read._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {**{r["id"]: (r["judgment"], r["tags"], r["strength"]) for r in records}, "bare": (None, [], None)}
    assert "SortMergeJoin" not in plan and not re.search(r"Sort \[file#\d+ ASC NULLS FIRST, block#\d+L? ASC NULLS FIRST, at#", plan)
