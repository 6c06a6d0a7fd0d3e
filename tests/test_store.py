"""Manifests, the change feed, the vector index and the chunk index of the store."""

import json
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from memlattice.api import MemoryStore
from memlattice.operators import retrieval as V, store
from memlattice.operators import chunk_index
from memlattice.operators.chunk_index import ChunkIndex
from memlattice.storage import Conflict, Snapshots, State, changes


def letters(dim):
    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(t.count(chr(97 + k))) for k in range(dim)])

    return embed


def contents(df):
    return sorted(map(str, df.collect()))


def test_a_commit_is_whole_or_not_at_all(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"), {})
    first = s.commit(s.state(), {"a": spark.range(3), "b": spark.range(5)}, {"x": "1"})
    broken = spark.range(4).select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        s.commit(first, {"a": spark.range(9), "b": broken})
    assert s.state() == first and s.read("a").count() == 3 and s.read("b").count() == 5
    assert s.vacuum(0) == 0  # what was written of it is gone
    second = s.commit(first, {"a": spark.range(7)}, {"x": None})
    assert s.read("a").count() == 7 and s.read("b").count() == 5 and second.properties == {}
    assert s.read("a", first).count() == 3  # readers of the state before
    with pytest.raises(Conflict):
        s.commit(first, {"b": spark.range(1)})
    assert s.read("b").count() == 5 and s.state().version == 2
    for _ in range(4):
        s.commit(s.state(), {"a": spark.range(1)})
    assert s.versions() == [4, 5, 6] and s.read("b").count() == 5


def test_no_writer_loses_what_it_wrote(spark, tmp_path):
    stores = [MemoryStore(spark, str(tmp_path / "s")) for _ in range(3)]
    errors = []

    def write(no):
        try:
            for k in range(2):
                stores[no].remember([{"id": f"{no}-{k}", "judgment": f"j {no} {k}", "tags": [f"t{no}"]}])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(no,)) for no in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert {r.id: r.tags for r in stores[0].memories().collect()} == {f"{no}-{k}": [f"t{no}"] for no in range(3) for k in range(2)}


def test_a_version_has_one_winner(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"), {}, keep=0)
    for version in range(1, 101):
        won, bar = [], threading.Barrier(3)

        def publish(no, version=version, won=won, bar=bar):
            bar.wait()
            try:
                s._publish(State(version, {"a": str(no)}, {}))
                won.append(str(no))
            except Conflict:
                pass

        threads = [threading.Thread(target=publish, args=(no,)) for no in range(3)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(won) == 1 and s.state(version).tables == {"a": won[0]}


def test_change_feed(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, None)], "id string, n int, t string")
    new = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("d", 4, "y")], "id string, n int, t string")
    assert sorted(tuple(r) for r in changes(old, new, "id").collect()) == [("b", "update", 2, None), ("c", "delete", None, None), ("d", "insert", 4, "y")]
    assert changes(old, old, "id").count() == 0


def test_the_vector_index_follows(spark, tmp_path):
    root, embed = str(tmp_path / "s"), letters(4)
    s = MemoryStore(spark, root, embed=embed)
    truth = lambda: store.vector_index_rows(s.memories())
    index = lambda: s.tables.read("memory_vectors")
    empty = spark.createDataFrame([], "item_id string, vector_text string, embedding array<float>")
    same = lambda: contents(index()) == contents(V.vector_sync(truth(), empty, embed))
    s.remember([{"id": "a", "judgment": "aaa"}, {"id": "b", "judgment": "bbb", "tags": ["b"]}])
    assert same() and index().count() == 2
    s.feedback([], ["a"], [{"action": "merge", "source_memory_ids": ["a", "b"], "memory": {"type": "knowledge", "judgment": "abc", "tags": []}}])
    assert same() and index().count() == 1
    other = MemoryStore(spark, root)  # knows of no vectors
    other.remember([{"id": "c", "judgment": "ccc"}, {"id": "d", "judgment": "dddd"}])
    other.delete([r.id for r in s.memories().filter("judgment = 'abc'").collect()])
    assert not same()
    stream = s.follow_stream(str(tmp_path / "checkpoint"))
    stream.awaitTermination(120)
    assert stream.exception() is None and same()
    version = s.tables.state().version
    s.follow_stream(str(tmp_path / "again")).awaitTermination(120)  # every commit once more
    assert s.follow().version == version and same()
    assert [r.id for r in s.recall("zzz ccc").collect()] == ["c"]
    other.remember([{"id": "c", "judgment": "ab"}])
    s.sleep(str(tmp_path / "backup"))
    assert same() and s.tables.state().properties["vectors"]
    for _ in range(9):  # the version that the index followed is no longer kept
        other.remember([{"id": "e", "judgment": "e d"}])
    s.follow()
    assert same()
    s.clear_vectors()
    assert "memory_vectors" not in s.tables.state().tables
    s.follow()
    assert same()


def test_generations_of_vectors(spark, tmp_path):
    root = str(tmp_path / "s")
    old = MemoryStore(spark, root, embed=letters(3), space="three")
    old.remember([{"id": i, "judgment": i * 3} for i in "abc"])
    new = MemoryStore(spark, root, embed=letters(5), space="five")
    assert new._nearest("a", 1) is None and [r.id for r in old._nearest("b", 1).collect()] == ["b"]
    tries = []

    @F.pandas_udf("array<float>")
    def failing(s: pd.Series) -> pd.Series:
        raise ValueError("no model")

    new.embed = letters(5)
    change = new._change

    def stops(plan, *a):
        tries.append(plan)
        if len(tries) == 3:
            raise RuntimeError("stopped")
        return change(plan, *a)

    new._change = stops
    with pytest.raises(RuntimeError):
        new.rebuild_vectors(4)
    assert [r.id for r in old._nearest("b", 1).collect()] == ["b"]  # the old generation still answers
    assert json.loads(new.tables.state().properties["building"])["done"] == [0, 1]
    new.remember([{"id": "d", "judgment": "ddd"}])
    new._change = change
    new.rebuild_vectors(4)
    assert old._nearest("b", 1) is None and [r.id for r in new._nearest("d", 1).collect()] == ["d"]
    assert {len(r.embedding) for r in new.tables.read("memory_vectors").collect()} == {5} and "building" not in new.tables.state().properties
    assert not [n for n in new.tables.state().tables if n.startswith("vectors_part_")]


CHUNKS = "file_id string, source_file_path string, chunk_index int, line_start int, line_end int, content string"


def test_the_stored_index_finds_what_a_search_of_the_text_finds(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "红烧肉", "the"]
    rows = [(f"f{k % 7}", f"f{k % 7}.md", k, 0, 1, " ".join(words[(k * j) % 5] for j in range(1, 2 + k % 4))) for k in range(40)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    index = ChunkIndex(spark, str(tmp_path / "i"), buckets=8).build(chunks)

    def same(now, index):
        for query in ("alpha|beta", "红烧肉 the", "f3", "nothing"):
            for cap in (1, 2):
                text, stored = (V.note_search(now, query, 10, per_file=cap, index=i).select("id", "matched", F.round("score", 9)).collect() for i in (None, index))
                assert text == stored, query

    same(chunks, index)
    new = spark.createDataFrame([("f1", "f1.md", 1, 0, 1, "alpha delta"), ("f9", "f9.md", 1, 0, 1, "the 红烧肉")], CHUNKS)
    gone = spark.createDataFrame([("f2",), ("f1",), ("never",)], "file_id string")
    second = index.replace(new, gone)
    now = chunks.filter("file_id not in ('f1', 'f2')").union(new)
    same(now, second)
    assert len(second.segments) == 2 and len(index.segments) == 1
    same(chunks, index)  # the value before
    third = second.delete(spark.createDataFrame([("f9",)], "file_id string")).replace(chunks.filter("file_id = 'f2'"))
    same(now.filter("file_id != 'f9'").union(chunks.filter("file_id = 'f2'")), third)
    whole = third.compact()
    same(now.filter("file_id != 'f9'").union(chunks.filter("file_id = 'f2'")), whole)
    assert len(whole.segments) == 1 and whole.files().filter("file_id = 'f9'").count() == 0
    # only the buckets of the asked terms are read
    plan = whole.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert ChunkIndex(spark, str(tmp_path / "none")).hits(["x"])[0].count() == 0


def test_notes_change_only_their_own_postings(spark, tmp_path):
    s, folder = MemoryStore(spark, str(tmp_path / "s")), tmp_path / "notes"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.md").write_text(f"# note {k}\n\ncommon word{k}")
    s.sync_notes(str(folder))
    segments = lambda: json.loads(s.tables.state().properties["chunk_index"])
    assert s.recall_notes("common").count() == 3 and len(segments()) == 1
    s.sync_notes(str(folder))
    assert len(segments()) == 1  # nothing changed
    import os

    (folder / "1.md").write_text("# note 1\n\nother text")
    os.utime(folder / "1.md", (2e9, 2e9))
    (folder / "2.md").unlink()
    s.sync_notes(str(folder))
    assert len(segments()) == 2 and s.recall_notes("common").count() == 1 and s.recall_notes("other").count() == 1
    delta = ChunkIndex(spark, s.tables.root + "/chunk_index", segments()[1:])
    assert {r.file_id: r.chunks > 0 for r in delta.files().collect()} == {"1.md": True, "2.md": False}
    assert {r.file_id for r in delta.postings().select("file_id").collect()} == {"1.md"}
    (folder / "3.md").write_text("later")
    s.sync_notes(str(folder))
    ids = {r.source_id: r.note_short_id for r in s.tables.read("note_registry").collect()}
    assert ids == {"0.md": 0, "1.md": 1, "3.md": 3}  # 2 is not given again
    s.rebuild_chunk_index()
    assert len(segments()) == 1 and s.recall_notes("later").count() == 1
    s.clear_notes()
    assert s.recall_notes("later").count() == 0
    s.sync_notes(str(folder))
    assert sorted(r.note_short_id for r in s.tables.read("note_registry").collect()) == [0, 1, 2]


def test_links_go_with_their_memories(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path / "s"))
    s.remember([{"id": "a", "judgment": "same", "tags": ["x"]}, {"id": "b", "judgment": "same", "tags": ["y"]}, {"id": "c", "judgment": "c", "tags": ["z"]}])
    batch = s.tables.read("records").filter("id = 'a'").withColumn("created_at", F.col("created_at") + 5).withColumn("seq", F.lit(1))
    s.restore(batch)
    assert s.tables.read("records").count() == 2
    held = {r.id for r in s.tables.read("records").collect()}
    assert {r.memory_id for r in s.tables.read("memory_tag_rel").collect()} == held


def test_an_index_tokenises_once_and_compacts_without_a_shuffle(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(content):
        read.add(1)
        return content

    rows = [(f"f{i % 7}", f"f{i % 7}", i, f"word{i % 5} shared {'' if i % 4 else 'rare' + str(i)}") for i in range(60)] + [("empty", "", 0, "")]
    chunks = spark.createDataFrame(rows, "file_id string, source_file_path string, chunk_index long, content string")
    first = ChunkIndex(spark, str(tmp_path / "i"), buckets=4).build(chunks.withColumn("content", F.udf(seen, "string")("content")))
    assert read.value == len(rows)
    files = {r.file_id: (r.chunks, r.total0, r.total1) for r in first.files().collect()}
    tokens = lambda t: len(set(t.split()))
    assert files == {f: (sum(r[0] == f for r in rows), sum(tokens(r[3]) for r in rows if r[0] == f), sum(tokens(r[1]) for r in rows if r[0] == f)) for f in {r[0] for r in rows}}
    second = first.replace(chunks.filter("file_id = 'f1'").withColumn("content", F.lit("other")), chunks.filter("file_id = 'f2'"))
    living = lambda i: sorted(map(tuple, i.postings().select("term", "field", "file_id", "chunk_index", "length", "bucket").collect()))
    parts = lambda i: len(i.postings().inputFiles())
    whole = second.compact()
    assert living(whole) == living(second) and not any(p[2] == "f2" for p in living(whole)) and parts(whole) <= parts(second)
    assert whole.files().count() == 7 and len(whole.segments) == 1
    # with more parts than may be copied they are dealt anew
    most, chunk_index.MOST_PARTS = chunk_index.MOST_PARTS, 0
    try:
        assert living(second.compact()) == living(second)
    finally:
        chunk_index.MOST_PARTS = most
