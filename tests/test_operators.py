"""Retrieval, lifecycle, notes, sessions and chat on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from memlattice.functions.scoring import DecayConfig
from memlattice.operators import browse, chat as C, lifecycle as L, notes as N, ranking as R, retrieval as V, simulate as S, store
from memlattice.schemas import MEMORY_RECORD

DAY = 86400.0


def memory(i, judgment="j", scope="public", strength=3, active=False, score=0.0, created=0.0, recalled=0.0, decayed=0.0, kind="知识记忆", count=0):
    return (i, kind, judgment, "", strength, active, count, score, recalled, decayed, created, created, scope)


@pytest.fixture(scope="module")
def records(spark):
    rows = [memory("a", "红烧肉 recipe"), memory("b", "cat food", "x", score=5.0), memory("c", "dog food", "y", strength=1, created=1.0), memory("d", "old", active=True, strength=0)]
    return spark.createDataFrame(rows, MEMORY_RECORD)


CHUNKS = "file_id string, source_file_path string, chunk_index int, line_start int, line_end int, content string"


def test_note_search(spark):
    rows = [("a", "a.md", 1, 0, 1, "alpha only"), ("a", "a.md", 2, 2, 3, "beta only"), ("b", "b.md", 1, 0, 1, "alpha beta together"), ("t", "旅行/x.md", 1, 0, 1, "无关")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    got = V.note_search(chunks, "alpha|beta", 10, per_file=1).collect()
    assert [r.file_id for r in got][0] == "b" and len(got) == 2
    assert [r.file_id for r in V.note_search(chunks, "旅行", 10).collect()] == ["t"]
    assert V.note_search(chunks, "  ", 10).count() == 0
    # a scorer turns the order round; one that fails leaves it
    turned = V.note_search(chunks, "alpha|beta", 10, scorer=lambda q, docs: [-float(len(x)) for x in docs]).collect()
    assert len(turned) >= 2 and [len(r.content) for r in turned] == sorted(len(r.content) for r in turned)
    def broken(q, docs):
        raise RuntimeError("no answer")
    assert [r.id for r in V.note_search(chunks, "alpha|beta", 10, scorer=broken).collect()] == [r.id for r in V.note_search(chunks, "alpha|beta", 10).collect()]
    assert V.fetch_ceiling("猫", 6) == 6400 and V.fetch_ceiling("红烧", 6) == 1920 and V.fetch_ceiling("ab", 6) == 400
    assert V.note_search(chunks.filter("file_id = 'zz'"), "alpha", 10).count() == 0


def test_vectors(spark):
    unit = {"alpha": [1.0, 0.0, 0.0], "beta": [0.0, 1.0, 0.0], "gamma": [0.0, 0.0, 1.0]}

    @F.pandas_udf("array<float>")
    def embed(s):
        import pandas as pd

        table = {"alpha": [1.0, 0.0, 0.0], "beta": [0.0, 1.0, 0.0], "gamma": [0.0, 0.0, 1.0]}
        return pd.Series([table.get(t, [1.0, 1.0, 0.0]) for t in s])

    empty = spark.createDataFrame([], "item_id string, vector_text string, embedding array<float>")
    first = V.vector_upsert(empty, spark.createDataFrame([("m1", "alpha", 0), ("m2", "beta", 1), ("m1", "gamma", 2)], "item_id string, vector_text string, pos int"), embed)
    assert [(r.id, r.score) for r in V.vector_top_k(first, "item_id", "embedding", unit["beta"], 1).collect()] == [("m2", 1.0)]
    truth = spark.createDataFrame([("m1", "changed"), ("m3", "gamma")], "item_id string, vector_text string")
    diff = {r.item_id: r.change for r in V.vector_diff(truth, first).collect()}
    assert diff == {"m1": "changed", "m2": "orphan", "m3": "missing"}
    after = V.vector_sync(truth, first, embed)
    assert V.vector_diff(truth, after).count() == 0 and after.count() == 2
    assert V.vector_top_k(after, "item_id", "embedding", [1.0, 0.0], 5).count() == 0  # another dimension


def test_rrf(spark):
    hits = spark.createDataFrame([("a", 9.0, 1.0), ("b", 8.0, 0.8)], "id string, bm25_score double, bm25_normalized_score double")
    vec = spark.createDataFrame([("a", 0.95), ("b", 0.9)], "id string, score double")
    got = V.fuse(hits, vec, 10).collect()
    assert [r.id for r in got] == ["a", "b"] and all(0 < r.final_score < 0.5 and r.score_kind == "rrf" for r in got)
    assert V.fuse(hits.limit(0), vec, 10).count() == 0


def test_strategy_ladder(spark):
    docs = spark.createDataFrame([(f"m{k}", "word " * k) for k in (1, 2, 3)], "id string, body string")
    assert V.search_with_strategy(docs, "id", ["body"], "word", 2).count() == 2
    vec = spark.createDataFrame([("m3", 0.99), ("m4", 0.5)], "id string, score double")
    ranked = V.search_with_strategy(docs, "id", ["body"], "word", 2, vec, lambda q, d: [float(len(x)) for x in d])
    assert ranked.first().id == "m3" and ranked.count() == 4  # not cut to the limit

    def broken(q, d):
        raise ValueError("no service")

    assert {r.score_kind for r in V.search_with_strategy(docs, "id", ["body"], "word", 2, vec, broken).collect()} == {"rrf"}
    assert V.normalize_rerank_response({"data": {"results": [{"index": 1, "relevance_score": 0.5}, {"score": 0.1}]}}) == [(1, 0.5), (1, 0.1)]
    assert V.normalize_rerank_response({"code": 500, "results": [{"score": 1}]}) == []


def test_scopes(spark, records):
    assert {r.id for r in records.filter(V.scope_filter("x")).collect()} == {"a", "b", "d"}
    with pytest.raises(ValueError):
        V.scope_filter(" ")
    tagged = records.withColumn("tags", F.array().cast("array<string>"))
    assert [r.id for r in V.ordered_lookup(tagged, ["c", "b", "a", "b"], "x").collect()] == ["b", "a"]
    assert {r.id for r in V.recall(tagged, "food", 5, "x").collect()} == {"b"}


def test_decay_and_consolidation(spark):
    c = DecayConfig(cycle_days=3)
    rows = [memory("p", strength=3, created=0.0), memory("act", strength=3, active=True), memory("hi", strength=3, score=5.0), memory("gone", strength=1), memory("dec", strength=5, recalled=9 * DAY, decayed=3 * DAY)]
    df = spark.createDataFrame(rows, MEMORY_RECORD)
    got = {r.id: (r.strength, r.last_decay_at) for r in L.natural_decay(df, 7.5 * DAY, c).collect()}
    assert got["p"] == (1, 6 * DAY) and got["act"] == (3, 0.0) and got["hi"] == (3, 0.0) and got["dec"] == (4, 6 * DAY)
    twice = L.natural_decay(L.natural_decay(df, 7.5 * DAY, c), 7.5 * DAY, c)
    assert {r.id: r.strength for r in twice.collect()} == {k: v[0] for k, v in got.items()}
    bridge = spark.createDataFrame([("p", 1), ("gone", 1)], "memory_id string, tag_id long")
    kept, links = L.consolidate(df, bridge, 7.5 * DAY, c)
    assert "gone" not in {r.id for r in kept.collect()} and [r.memory_id for r in links.collect()] == ["p"]


ACTIONS = "action_no int, action string, source_memory_ids array<string>, memory struct<type:string,judgment:string,reasoning:string,tags:array<string>>"


def test_actions(spark, records):
    m = ("knowledge", "new", "why", [" t ", "t"])
    rows = [(1, "create", ["9"], m), (2, "merge", ["a", "a", "b", ""], m), (3, "updata", ["c", "c"], m), (4, "updata", ["c", "d"], m), (5, "merge", [], m), (6, "drop", ["a"], m), (7, "create", None, ("task", "x", None, None)), (8, "create", None, None)]
    norm = L.normalize_actions(spark.createDataFrame(rows, ACTIONS))
    got = {r.action_no: list(r.source_memory_ids) for r in norm.collect()}
    assert got == {1: [], 2: ["a", "b"], 3: ["c"]}
    after = L.apply_actions(records, norm, 100.0)
    by = {r.judgment: r for r in after.filter("judgment = 'new'").collect()}
    assert after.count() == 4 and sorted(r.strength for r in after.filter("judgment = 'new'").collect()) == [1, 6, 10]
    assert {r.memory_scope for r in after.filter("judgment = 'new'").collect()} == {"public", "x", "y"} and by
    both = L.normalize_actions(spark.createDataFrame([(1, "merge", ["b", "c"], m)], ACTIONS))
    with pytest.raises(Exception, match="private scope"):
        L.apply_actions(records, both, 1.0).collect()


def test_judgment_upsert(spark):
    old = spark.createDataFrame([("j1", "o1", 5.0, 5.0), ("j1", "o2", 9.0, 9.0), ("j2", "o3", 50.0, 50.0), ("j9", "o9", 1.0, 1.0)], "judgment string, id string, created_at double, updated_at double")
    new = spark.createDataFrame([("j1", "n1", 9.0, 9.0, 1), ("j1", "n2", 9.0, 9.0, 2), ("j2", "n3", 7.0, 7.0, 3), ("j3", "n4", 1.0, 1.0, 4)], "judgment string, id string, created_at double, updated_at double, seq int")
    got = {r.judgment: (r.id, r.outcome) for r in L.upsert_by_judgment(old, new).collect()}
    assert got == {"j1": ("o2", "updated"), "j2": ("o3", "skipped"), "j3": ("n4", "inserted"), "j9": ("o9", "kept")}


def line_loop(content, most):
    """The chunks of a note, line by line."""
    lines, spans, kind, at, size = content.split("\n"), [], None, 0, 0
    for n, line in enumerate(lines, 1):
        fence, row, blank = line.startswith("```"), line.startswith("|"), not line.strip()
        if kind == "code":
            if fence and not line[3:].strip():
                spans.append((at, n))
                kind = None
            continue
        if (kind == "row" and row) or (kind == "text" and not (fence or row or blank) and size + len(line) <= most):
            size += len(line)
            continue
        if kind:
            spans.append((at, n - 1))
        kind, at, size = "code" if fence else "row" if row else None if blank else "text", n, len(line)
    if kind:
        spans.append((at, len(lines)))
    return spans


@pytest.mark.parametrize("length,most", [(4, 220), (3, 2)])
def test_chunker_against_a_line_loop(spark, monkeypatch, length, most):
    import random

    monkeypatch.setattr(N, "SLICE", length)
    rng = random.Random(length)
    kinds = ["text", "文字 text", "", " \t", "\u3000", "```", "```py", "``` ", "|a|", "| ", "x" * 300]
    notes = [(str(k), None if k % 7 == 0 else "p.md", "\n".join(rng.choice(kinds) for _ in range(rng.randrange(0, 25)))) for k in range(200)]
    notes.append(("long", "p.md", "\n".join(["line"] * 3000)))
    got = {}
    for r in N.chunk_notes(spark.createDataFrame(notes, "file_id string, source_file_path string, content string"), most).collect():
        got.setdefault(r.file_id, []).append((r.chunk_index, r.line_start, r.line_end, r.content))
    for i, path, content in notes:
        lines, path = content.split("\n"), path or ""
        want = [(k, a, b, "\n".join(lines[a - 1 : b])) for k, (a, b) in enumerate(line_loop(content, most), 1)]
        want = [(1, 0, want[0][2], f"{path}\n{want[0][3]}"), *want[1:]] if want else [(1, 0, 0, path)]
        assert sorted(got[i]) == want, i


@pytest.fixture
def chunker(spark):
    def run(t, path="p.md", most=220):
        rows = N.chunk_notes(spark.createDataFrame([("f", path, t)], "file_id string, source_file_path string, content string"), most).collect()
        return sorted((r.chunk_index, r.line_start, r.line_end, r.content) for r in rows)

    return run


def test_chunker(spark, chunker):
    def chunk(t, most=220):
        return [(a, b) for _, a, b, _ in chunker(t, most=most)]

    assert chunker("") == [(1, 0, 0, "p.md")] == chunker(" \n ") == chunker(None)
    assert chunker("Hello world") == [(1, 0, 1, "p.md\nHello world")]
    assert chunk("a\n\nb\n\nc") == [(0, 1), (3, 3), (5, 5)]
    assert chunk("1\n2\n3\n\n4\n5") == [(0, 3), (5, 6)]
    assert chunk("intro\n\n```py\nx = 1\n\n```\nout") == [(0, 1), (3, 6), (7, 7)]
    assert chunk("```\nnever closed\nx") == [(0, 3)]
    assert chunk("t\n|a|b|\n|-|-|\nend") == [(0, 1), (2, 3), (4, 4)]
    assert len(chunk("\n".join(["ten chars."] * 30), 100)) == 3
    assert chunk("x" * 500, 100) == [(0, 1)]
    notes = spark.createDataFrame([("f", "p.md", "a\n\nb"), ("g", "q.md", None)], "file_id string, source_file_path string, content string")
    out = N.chunk_notes(notes)
    assert out.count() == 3 and out.schema["chunk_index"].dataType.typeName() == "integer"
    assert N.chunk_stats(out).first().asDict() == {"total_chunks": 3, "total_files": 2}


def test_file_sync(spark):
    index = spark.createDataFrame([("gone.md", 1), ("same.md", 5), ("new.md", 1)], "relative_path string, file_timestamp long")
    disk = spark.createDataFrame([("live.md", 1, "x"), ("same.md", 5, "y"), ("new.md", 2, "z")], "relative_path string, file_timestamp long, content string")
    assert {r.relative_path: r.change for r in N.file_diff(index, disk).collect()} == {"gone.md": "delete", "live.md": "add", "same.md": "unchanged", "new.md": "add"}
    chunks = spark.createDataFrame([("same.md", "same.md", 1, 0, 1, "old"), ("gone.md", "gone.md", 1, 0, 1, "old")], CHUNKS)
    after, _ = N.sync_chunks(chunks, index, disk)
    assert {r.file_id: r.content for r in after.collect()} == {"same.md": "old", "live.md": "live.md\nx", "new.md": "new.md\nz"}
    rebuilt, _ = N.sync_chunks(chunks, index, disk, stored_version="other")
    assert {r.content for r in rebuilt.collect()} == {"live.md\nx", "same.md\ny", "new.md\nz"}


def test_sessions(spark):
    schema = "session string, id string, memory_type string, priority int, added_at double, user_id string"
    state = spark.createDataFrame([("s", "1", "event", 1, 1.0, "u"), ("s", "2", "event", 1, 2.0, "u"), ("s", "3", "skill", 0, 1.0, "v")], schema)
    assert {r.id for r in R.capacity_evict(state, {"event": 1}, 9).collect()} == {"2", "3"}
    assert {r.id for r in R.shared_capacity(state, 2).collect()} == {"2", "3"}
    batch = spark.createDataFrame([("s", "9", "event", 1, 3.0, "v", 0), ("s", "8", "event", 1, 3.0, "u", 1), ("s", "1", "event", 1, 3.0, "u", 2)], schema + ", pos int")
    assert [r.id for r in R.admit(state, batch, 4).collect()] == ["9"]


def test_chat(spark):
    rows = [("s", 1, "user", "hello there", "123456", "小明", 1.0, False), ("s", 2, "user", "hi", "", "", 2.0, False), ("s", 3, "user", "again hello", "123456", "明仔", 3.0, None), ("s", 4, "assistant", "tool_call x", "", "bot", 4.0, False), ("s", 5, "user", "/cmd long", "654321", " ", 5.0, False)]
    c = spark.createDataFrame(rows, "session string, seq long, role string, content string, sender_id string, sender_name string, ts double, is_processed boolean")
    assert [(r.sender_id, r.latest_name) for r in C.users(c).orderBy("first_seq").collect()] == [("123456", "明仔"), ("654321", "")]
    assert {r.seq for r in C.gate(c).collect()} == {1, 3, 4}
    assert {r.seq for r in C.unprocessed(c).collect()} == {1, 2, 4, 5}
    assert {r.seq for r in c.filter(C.identified(F.col("sender_id"), F.col("sender_name"))).collect()} == {1, 3, 4, 5}
    assert 4 not in {r.seq for r in C.no_tool_calls(c).collect()}
    assert C.dedupe(c.union(c)).count() == 5
    turns = spark.createDataFrame([("s", k, float(k)) for k in range(8)] + [("s", 8, 700.0)], "session string, seq long, ts double")
    got = C.reflection_batches(turns).groupBy("batch_no").agg(F.count("*").alias("n"), F.first("trigger").alias("t")).orderBy("batch_no").collect()
    assert [(r.n, r.t) for r in got] == [(6, "count"), (2, "idle"), (1, "idle")]


def test_store(spark, records):
    dim, bridge = spark.createDataFrame([(7, "x")], "id long, name string"), spark.createDataFrame([("a", 7)], "memory_id string, tag_id long")
    tagged = spark.createDataFrame([("a", ["y", "x"]), ("b", ["y", " "])], "id string, tags array<string>")
    grown, links = store.bind_tags(dim, bridge, tagged)
    assert {(r.id, r.name) for r in grown.collect()} == {(7, "x"), (8, "y")}
    assert {tuple(r) for r in links.collect()} == {("a", 7), ("a", 8), ("b", 8)}
    full = {r.id: r.tags for r in store.with_tags(records, grown, links).collect()}
    assert full == {"a": ["x", "y"], "b": ["y"], "c": [], "d": []}
    asked = spark.createDataFrame([(0, "q"), (1, "x"), (2, "a0")], "pos int, name string")
    assert [(r.name, r.id) for r in store.names_to_ids(dim, asked).collect()] == [("q", 9), ("x", 7), ("a0", 8)]
    rep = {tuple(r) for r in store.replace_tags(grown, links, spark.createDataFrame([("a", ["z"])], "id string, tags array<string>"))[1].collect()}
    assert rep == {("a", 9), ("b", 8)}
    reg = spark.createDataFrame([("s1", 0, "a.md", "h", 1, 1.0), ("s2", 1, "b.md", "h", 1, 1.0)], "source_id string, note_short_id long, source_file_path string, heading string, total_lines int, updated_at double")
    new = spark.createDataFrame([("s1", "c.md", "写入标题", 12, 2.0), ("s9", "b.md", "t", 2, 2.0), ("s8", "d.md", "t", 2, 2.0)], "source_id string, source_file_path string, heading string, total_lines int, updated_at double")
    got = {r.source_id: (r.note_short_id, r.source_file_path, r.total_lines) for r in store.register_notes(reg, new).collect()}
    assert got == {"s1": (0, "c.md", 12), "s9": (1, "b.md", 2), "s8": (2, "d.md", 2)}
    rows = spark.createDataFrame([("s1", "zz"), ("q", "b.md"), ("q", "q")], "file_id string, source_file_path string")
    assert sorted(r.note_short_id for r in store.with_short_ids(rows, reg).collect()) == [-1, 0, 1]


def test_profiles(spark, records):
    t = spark.createDataFrame([("p", ["123456", "用户别名", "小明"]), ("q", ["x"])], "id string, tags array<string>")
    m = t.join(records.drop("id").limit(1))
    assert [r.nickname for r in browse.profiles(m).collect()] == ["小明"]
    assert [r.id for r in browse.without_profiles(m, browse.profiles(m).select("id")).collect()] == ["q"]
    assert browse.keyword_filter(m.withColumn("judgment", F.lit("50%_x")), "%_").count() == 2
    assert browse.keyword_filter(m, "%_").count() == 0


def test_simulator(spark):
    import statistics

    v = [5.0, 1.0, 9.0, 3.0, 7.0, 2.0]
    want = statistics.quantiles(v, n=10)[8]
    assert math.isclose(S.p90_exclusive(v), want)
    got = spark.createDataFrame([(v,)], "v array<double>").select(S.p90_column(F.col("v")).alias("p")).first().p
    assert math.isclose(got, want)
    r = S.simulate(S.grid(spark, [6], [1], 1, calls_per_day=200, days=365, speed=1.0)).first()
    assert r.created == 200 * 365 and r.deleted + r.alive == r.created and r.t0 + r.t1 + r.t2 == r.alive
    assert 0.85 < r.deleted / r.created < 0.99  # the published runs delete about 95 %


def test_texts_are_not_sorted_for_actions(spark, records, monkeypatch):
    m = ("knowledge", "new", "why", ["t"])
    norm = L.normalize_actions(spark.createDataFrame([(1, "merge", ["a", "b", "none"], m), (2, "updata", ["b"], m)], ACTIONS))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for few, join in [(100, "BroadcastHashJoin"), (0, "ShuffledHashJoin")]:
            monkeypatch.setattr(L, "FEW", few)
            after = L.apply_actions(records, norm, 100.0)
            plan = after._jdf.queryExecution().executedPlan().toString()
            assert [x for x in plan.splitlines() if "LeftAnti" in x and join in x]
            assert sorted(r.judgment for r in after.collect()) == sorted(["new", *(r.judgment for r in records.filter("id not in ('a', 'b')").collect())])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_queries_are_scored_without_a_row_for_each_term(spark, monkeypatch):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["红烧", "天地人"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(400)]
    rows += [(1000 + i, "same words w1 w2") for i in range(20)] + [(7, "w3 again"), (None, "w1 w2 w3"), (None, "w1"), (2000, None), (2001, "")]
    asked = [(q, t) for q in [*"abcdefgh", None] for t in rng.sample(words, 6)] + [("a", "w1"), ("a", "w1"), ("z", "nowhere"), ("z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query string, term string")
    scored = V.score_postings(V.postings(docs, "doc_id", ["text"]), V.index_statistics(docs, ["text"]), queries.filter("query is not null")).collect()
    nulls = V.score_postings(V.postings(docs, "doc_id", ["text"]), V.index_statistics(docs, ["text"]), queries.filter("query is null").fillna("null")).collect()
    want = []
    for q in {r.query for r in scored} | {"null"}:
        mine = sorted((-round(r.bm25_score, 6), -1 if r.id is None else r.id) for r in [*scored, *nulls] if r.query == q)
        want += [(q, i, -s) for s, i in mine[:5]]
    for tile_docs, tile_queries in [(4096, 256), (50, 3)]:
        monkeypatch.setattr(V, "TILE_DOCS", tile_docs)
        monkeypatch.setattr(V, "TILE_QUERIES", tile_queries)
        found = V.top_of_many(docs, "doc_id", "text", queries, 5)
        got = [(r.query or "null", -1 if r.id is None else r.id, r.score) for r in found.collect()]
        assert sorted(got) == sorted(want)
    assert V.top_of_many(docs.limit(0), "doc_id", "text", queries, 5).count() == 0
    assert V.top_of_many(docs, "doc_id", "text", queries.limit(0), 5).count() == 0
