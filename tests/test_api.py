"""The store end to end, on a temporary folder."""

from memlattice.api import MemoryStore


def test_store(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path / "store"))
    assert s.memories().count() == 0 and s.recall("cat").count() == 0
    s.remember([{"id": "a", "judgment": "cats like fish", "tags": ["pet", "cat"]}, {"id": "b", "judgment": "dogs bark", "tags": ["pet"], "memory_scope": "x"}, {"id": "u", "judgment": "likes tea", "tags": ["123456", "用户别名", "Ann"]}])
    assert [r.id for r in s.recall("cats fish").collect()] == ["a"]
    assert s.recall("dogs").count() == 0 and s.recall("dogs", scope="x").count() == 1
    assert [r.id for r in s.recall("pet", entities=["cat"], per_type=2).collect()] == ["a"]
    s.feedback(["a"], ["a", "b"], [{"action": "merge", "source_memory_ids": ["a", "b"], "memory": {"type": "knowledge", "judgment": "pets", "tags": []}}])
    assert {r.judgment: (r.strength, r.memory_scope) for r in s.memories().collect()}["pets"] == (21, "x")
    assert s.profiles().first().user_id == "123456" and s.overview().first().records == 2
    assert s.browse(keyword="tea").count() == 1
    s.delete(["u"])
    s.sleep(str(tmp_path / "backup"))
    assert s.overview().first().records == 1 and s.overview().first().links == 0
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.md").write_text("# Cooking\n\n红烧肉 needs sugar\n\nend")
    s.sync_notes(str(folder))
    hit = s.recall_notes("红烧肉").collect()
    assert len(hit) == 1 and hit[0].note_short_id == 0 and hit[0].line_start == 3
    assert "sub" not in s.create_note(str(folder), "My: note", "body")
    s.sync_notes(str(folder))
    assert s.recall_notes("body").count() == 1 and [r.line for r in s.read_note(str(folder), "a.md", 0, 1).collect()] == ["# Cooking"]
    (folder / "a.md").unlink()
    s.sync_notes(str(folder))
    assert s.recall_notes("红烧肉").count() == 0
