"""Stateful streams against their batch forms, and file sources."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from memlattice.operators.ranking import Knowledge, knowledge_capacity
from memlattice.sources import files, snapshots
from memlattice.streaming import stateful as S


def feed(spark, tmp_path, name, batches, schema, build):
    """Runs a stream over JSON files, one trigger a file; returns all rows that came out, with their batch."""
    src, out = tmp_path / name, []
    src.mkdir()
    for k, rows in enumerate(batches):
        (src / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(src / f"{k}.json", (k + 1, k + 1))
    S.keep_state_in_rocksdb(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = build(stream).writeStream.foreachBatch(lambda df, i: out.extend((i, r) for r in df.collect())).outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    try:  # a stream with timers has no end of its own
        for _ in range(240):
            if q.exception() is not None or sum(p["numInputRows"] for p in q.recentProgress) >= sum(map(len, batches)):
                break
            time.sleep(0.25)
        assert q.exception() is None
    finally:
        q.stop()
    return out


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Few keys: a state store for each of four partitions would take most of the time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


TURN = "session string, seq long, ts double, ack long, ok boolean"


def test_reflection_stream(spark, tmp_path):
    turn = lambda s, k: {"session": s, "seq": k, "ts": float(k)}
    batches = [[turn("s", k) for k in range(4)], [turn("s", k) for k in range(3, 8)] + [turn("t", 1)], [{"session": "s", "ack": 1, "ok": False}], [turn("s", 99)], [{"session": "s", "ack": 2, "ok": True}], [turn("s", k) for k in range(100, 103)]]
    got = [(r.session, r.batch_no, r.trigger, r.seqs) for _, r in feed(spark, tmp_path, "turns", batches, TURN, S.reflection_stream)]
    # turn 3 came twice and counts once; the failed batch is first in line again; 6, 7 and 99 wait for three more
    assert got == [("s", 1, "count", "0,1,2,3,4,5"), ("s", 2, "count", "0,1,2,3,4,5"), ("s", 3, "count", "6,7,99,100,101,102")]


def test_a_silent_session_is_released_by_its_timer(spark, tmp_path):
    src, out = tmp_path / "turns", []
    src.mkdir()
    S.keep_state_in_rocksdb(spark)
    stream = S.reflection_stream(spark.readStream.schema(TURN).json(str(src)), idle=2.0)
    q = stream.writeStream.foreachBatch(lambda df, i: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        (src / "0.json").write_text("\n".join(json.dumps({"session": "s", "seq": k, "ts": 1.0 * k}) for k in range(2)))
        for _ in range(120):
            if out:
                break
            assert q.exception() is None
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r.session, r.batch_no, r.trigger, r.seqs, r.n) for r in out] == [("s", 1, "idle", "0,1", 2)]


def reference(i, p, t, kind="event", user=""):
    return {"session": "s", "id": i, "memory_type": kind, "priority": p, "added_at": t, "user_id": user}


def test_session_cache_stream(spark, tmp_path):
    out = feed(spark, tmp_path, "refs", [[reference("a", 1, 1.0)], [reference("b", 1, 2.0), reference("c", 5, 0.0)]], S.REFERENCES, lambda s: S.session_cache_stream(s, {"event": 2}, 9))
    last = max(i for i, _ in out)
    assert {r.id for i, r in out if i == last} == {"b", "c"}


def test_shares_shrink_when_a_user_joins(spark, tmp_path):
    k = Knowledge("fact", 2, 4)
    first = [reference(f"u{n}", n % 2, float(n), "fact", "1") for n in range(5)] + [reference(f"r{n}", 0, float(n), "fact") for n in range(3)]
    second = [reference("v", 9, 9.0, "fact", "2"), reference("u0", 0, 50.0, "fact", "1"), reference("e", 0, 0.0)]
    out = feed(spark, tmp_path, "refs", [first, second], S.REFERENCES, lambda s: S.session_cache_stream(s, {"event": 2}, 9, k))
    held = lambda no: {r.id for i, r in out if i == no}
    batches = sorted({i for i, _ in out})
    every = spark.createDataFrame([tuple(r.values()) for r in first], S.REFERENCES)
    assert held(batches[0]) == {"u1", "u3", "u0", "u2", "r1", "r2"} == {r.id for r in knowledge_capacity(every, k).collect()}
    now = [r for r in first if r["id"] in held(batches[0]) - {"u0"}] + second
    assert held(batches[-1]) == {"u1", "u3", "v", "r1", "r2", "e"} == {r.id for r in knowledge_capacity(spark.createDataFrame([tuple(r.values()) for r in now], S.REFERENCES), k).collect()}


def test_profiles_are_those_of_the_batch(spark, tmp_path):
    src = tmp_path / "chat"
    src.mkdir()
    schema = "session string, seq long, role string, content string, sender_id string, sender_name string"
    turn = lambda s, k, who: json.dumps({"session": s, "seq": k, "role": "user", "content": "x", "sender_id": who, "sender_name": f"n{k}"})
    (src / "0.json").write_text("\n".join([turn("s", 0, "123456"), turn("s", 1, "123456"), turn("t", 0, "654321")]))
    (src / "1.json").write_text(turn("s", 2, "123456"))
    for k in range(2):
        os.utime(src / f"{k}.json", (k + 1, k + 1))
    columns = "id string, memory_type string, judgment string, strength int, is_active boolean, updated_at double, memory_scope string, tags array<string>"
    store = [("p", "knowledge", "likes tea", 1, True, 1.0, "public", ["123456", "事实属性", "x"])]
    got = []

    def refresh(no, rows):
        got.append((no, sorted((r.session, r.user_id, r.latest_name, r.id) for r in rows.collect())))
        store.append(("q", "knowledge", "plays", 1, True, 2.0, "public", ["123456", "技能树", "y"]))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = S.profile_refresh_stream(stream, lambda: spark.createDataFrame(store, columns), refresh).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert got == [(0, [("s", "123456", "n1", "p")]), (1, [("s", "123456", "n2", "p"), ("s", "123456", "n2", "q")])]


def test_soul_stream_equals_fold(spark, tmp_path):
    rows = [{"key": "k", "ts": float(k), "seq": 0, "code": f"{k % 16:04b}", "mode": "reflect" if k % 2 else "resonate"} for k in range(20)]
    schema = "key string, ts double, seq int, code string, mode string"
    out = feed(spark, tmp_path, "soul", [rows[:7], rows[7:]], schema, S.soul_stream)
    want = S.fold_soul(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(list(out[-1][1])[1:], list(want)[1:], strict=True))


def test_sleep_gate():
    gate, ran = S.SleepGate(10), []
    assert gate.run(0, [lambda: ran.append(1)]) and not gate.run(5, [lambda: ran.append(2)]) and gate.run(10, [lambda: ran.append(3)])
    assert ran == [1, 3]
    assert S.SleepGate(1).due(0)


def test_files(spark, tmp_path):
    folder = tmp_path / "notes" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.md").write_bytes(b"# T\r\nx\xff\ry")
    (folder / "b.png").write_bytes(b"no")
    rows = files.read_notes(spark, str(tmp_path / "notes")).collect()
    assert [(r.relative_path, r.content) for r in rows] == [("sub/a.md", "# T\nx\ny")]
    assert files.scan_notes(spark, str(tmp_path / "notes")).columns == ["relative_path", "file_timestamp"]
    files.write_note(spark, str(tmp_path / "notes"), "c.txt", "hi")
    assert files.scan_notes(spark, str(tmp_path / "notes")).count() == 2
    rec = {"id": "m", "judgment": "j", "tags": ["t"], "is_active": True}
    back = tmp_path / "backup"
    back.mkdir()
    for k, shape in enumerate(({"records": [rec]}, {"memories": [rec]}, [rec, rec], {"records": []})):
        p = back / f"{k}.json"
        p.write_text(json.dumps(shape))
        os.utime(p, (1000 + k, 1000 + k))
        assert snapshots.read_snapshot(spark, str(p)).count() == (1, 1, 2, 0)[k]
    assert files.preview_backup(spark, str(back / "2.json")).first().active == 2
    assert len(files.prune_backups(spark, str(back), 3)) == 1 and sorted(os.listdir(back))[0] == "1.json"
    assert spark.range(1).select(F.lit(1)).count() == 1
    for day in ("20240101", "20240102", "20240103", "20240104", "other"):
        os.makedirs(back / day)
    assert files.prune_backup_folders(spark, str(back), 3) == ["20240101"] and os.path.isdir(back / "other")
