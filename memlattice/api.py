"""The public interface: a store of memories and notes.

All tables, the vector index and the chunk index stand under one manifest (``storage``): a mutation is a plan over the state that it read, and its tables
appear together or not at all.  If another writer was faster, the plan is made again over that writer's state.

With an embedder the vector index follows the memories: mutations through this class carry it along, ``follow`` applies the changes that other writers
committed, and ``sleep`` does so too.  The index belongs to one *space* (the embedder's model); one of another space is not searched, and
``rebuild_vectors`` makes the next generation beside it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.functions import text
from memlattice.functions.scoring import DecayConfig
from memlattice.operators import browse, lifecycle, notes, ranking, retrieval, store
from memlattice.operators.chunk_index import MOST_SEGMENTS, ChunkIndex
from memlattice.operators.vector_cells import VectorCells
from memlattice.schemas import GLOBAL_TAG, MEMORY_RECORD, MEMORY_TAG, NOTE_CHUNK, NOTE_REGISTRY, PUBLIC, VECTORS
from memlattice.session import share_path
from memlattice.sources import files
from memlattice.storage import MANIFEST, Conflict, Snapshots, State, changes

TABLES = {
    "records": MEMORY_RECORD, "global_tags": GLOBAL_TAG, "memory_tag_rel": MEMORY_TAG, "note_chunks": NOTE_CHUNK, "note_registry": NOTE_REGISTRY, "memory_vectors": VECTORS,
}
#: The tables that a memory's vector text is made of.
SOURCES = ("records", "global_tags", "memory_tag_rel")
#: Parts in which a new generation of vectors is made.
PARTS = 8
Plan = Callable[[State], tuple[dict[str, DataFrame], dict]]


def _followed(state: State) -> list[str | None]:
    return [state.tables.get(n) for n in SOURCES]


def _links_of(rel: DataFrame, records: DataFrame) -> DataFrame:
    """The links of memories that are there."""
    return rel.join(records.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")


class MemoryStore:
    """``embed`` turns a text column into vectors; ``space`` names its model."""

    def __init__(self, spark: SparkSession, root: str, decay: DecayConfig = DecayConfig(), embed=None, scorer=None, space: str = "default", keep: int = 8):
        self.spark, self.decay, self.embed, self.scorer, self.space = share_path(spark), decay, embed, scorer, space
        self.tables = Snapshots(spark, root, TABLES, keep)

    # -- states

    def _change(self, plan: Plan, tries: int = 8) -> State:
        """Commits what ``plan`` makes of the last state; makes it anew if another writer was faster."""
        for attempt in range(tries):
            state = self.tables.state()
            tables, properties = plan(state)
            if not tables and not properties:
                return state
            try:
                return self.tables.commit(state, tables, properties)
            except Conflict:
                if attempt + 1 == tries:
                    raise

    def _memories(self, state: State, **new: DataFrame) -> DataFrame:
        return store.with_tags(*[new[n] if n in new else self.tables.read(n, state) for n in SOURCES])

    def _change_memories(self, plan: Callable[[State], dict[str, DataFrame]]) -> State:
        """A change of the memory tables together with the vector index that goes with them."""

        def whole(state: State) -> tuple[dict[str, DataFrame], dict]:
            new = plan(state)
            held = self._index_of(state)
            if self.embed is None or (held and (held["space"] != self.space or held["followed"] != _followed(state))):
                return new, {}  # of another model, or behind: rebuild_vectors or follow bring it up
            if not held and "records" in state.tables:
                return new, {}
            index = retrieval.follow_records(self._vectors_at(state), self._vector_rows(state, **new).withColumnRenamed("item_id", "id"), self.embed)
            return new | {"memory_vectors": index}, {"vectors": self._mark}

        return self._change(whole)

    # -- the vector index

    def _mark(self, state: State) -> str:
        return json.dumps({"space": self.space, "followed": _followed(state), "version": state.version})

    def _index_of(self, state: State) -> dict:
        return json.loads(state.properties.get("vectors", "{}"))

    def _vectors_at(self, state: State) -> DataFrame:
        return self.tables.read("memory_vectors", state)

    def _vector_rows(self, state: State, **new: DataFrame) -> DataFrame:
        return store.vector_index_rows(self._memories(state, **new))

    def follow(self) -> State:
        """Brings the vector index to the memories: what changed between the version that it last followed and now is embedded or goes.

        The version is committed together with the index, so to do this again, or to do it late, changes nothing.  An index of another space
        is left alone; if the version that it followed is no longer kept, all texts are compared instead.
        """

        def plan(state: State) -> tuple[dict[str, DataFrame], dict]:
            held = self._index_of(state)
            if self.embed is None or (held and (held["space"] != self.space or held["followed"] == _followed(state))):
                return {}, {}
            now, index = self._vector_rows(state), self._vectors_at(state)
            then = None
            if held and held["version"] in self.tables.versions():
                then = self._vector_rows(self.tables.state(held["version"]))
            if then is None:
                return {"memory_vectors": retrieval.vector_sync(now, index, self.embed)}, {"vectors": self._mark}
            feed = changes(then, now, "item_id")
            fresh = feed.filter("change != 'delete'").select("item_id", "vector_text", F.lit(0).alias("pos"))
            rest = index.join(feed.filter("change = 'delete'").select("item_id"), "item_id", "left_anti")
            return {"memory_vectors": retrieval.vector_upsert(rest, fresh, self.embed)}, {"vectors": self._mark}

        return self._change(plan)

    def follow_stream(self, checkpoint: str, **trigger):
        """A streaming query over the commits of this store that keeps the vector index up to date; ``trigger`` as of ``DataStreamWriter.trigger``.

        A batch that is replayed finds its version followed and changes nothing.
        """
        commits = self.spark.readStream.schema(MANIFEST).option("ignoreMissingFiles", True).json(self.tables.manifests)
        return commits.writeStream.foreachBatch(lambda batch, _: self.follow() and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def clear_vectors(self) -> State:
        """No vector index at all; ``follow`` makes one."""
        state = self.tables.state()
        return self.tables.commit(state, {}, {"vectors": None, "building": None}, [n for n in state.tables if n == "memory_vectors" or n.startswith("vectors_part_")])

    def rebuild_vectors(self, parts: int = PARTS) -> State:
        """The next generation of the vector index, in this store's space, made in parts beside the one in use.

        Readers stay on the old generation until the new one is whole; if this is broken off, the next call goes on with the parts that are missing.
        """
        name = lambda k: f"vectors_part_{k}"
        for k in range(parts):

            def part(state: State, k: int = k) -> tuple[dict[str, DataFrame], dict]:
                building = json.loads(state.properties.get("building", "{}"))
                if building.get("space") != self.space or building.get("parts") != parts:
                    building = {"space": self.space, "parts": parts, "done": []}
                if k in building["done"]:
                    return {}, {}
                rows = self._vector_rows(state).filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
                made = retrieval.embed_distinct(rows, "vector_text", self.embed).select("item_id", "vector_text", F.col("embedding").cast("array<float>").alias("embedding"))
                return {name(k): made}, {"building": json.dumps(building | {"done": [*building["done"], k]})}

            self._change(part)
        for attempt in range(8):
            state = self.tables.state()
            made = self.tables.read(name(0), state)
            for k in range(1, parts):
                made = made.unionByName(self.tables.read(name(k), state))
            whole = retrieval.vector_sync(self._vector_rows(state), made, self.embed)  # what changed while the parts were made
            try:
                return self.tables.commit(state, {"memory_vectors": whole}, {"vectors": self._mark, "building": None}, [n for n in state.tables if n.startswith("vectors_part_")])
            except Conflict:
                if attempt == 7:
                    raise

    def cluster_vectors(self, cells: int | None = None) -> State:
        """Stores the vectors by cell, so that ``recall`` reads the cells that can hold its nearest ones; after a change of the vectors it scans again until the next call."""
        name = "memory_vectors"

        def plan(state: State) -> tuple[dict[str, DataFrame], dict]:
            held = json.loads(state.properties.get("cells", "{}"))
            if name not in state.tables or held.get("of") == state.tables[name]:
                return {}, {}
            made = VectorCells.build(self._vectors_at(state), "item_id", "embedding", f"{self.tables.root}/vector_cells", cells)
            return {}, {"cells": json.dumps({"of": state.tables[name], "path": made.path})}

        return self._change(plan)

    def _cells_at(self, state: State) -> VectorCells | None:
        """The cells, if they are of the vectors of this state."""
        held = json.loads(state.properties.get("cells", "{}"))
        return VectorCells(self.spark, held["path"]) if held and held["of"] == state.tables.get("memory_vectors") else None

    # -- memories

    def memories(self) -> DataFrame:
        return self._memories(self.tables.state())

    def remember(self, rows: list[dict]) -> None:
        """New memories: judgment, and any of reasoning, tags, memory_type, strength, is_active, memory_scope, id."""
        schema = "id string, judgment string, reasoning string, memory_type string, strength int, is_active boolean, memory_scope string, tags array<string>"
        now = F.lit(time.time())
        given = self.spark.createDataFrame([tuple(r.get(f) for f in ("id", "judgment", "reasoning", "memory_type", "strength", "is_active", "memory_scope", "tags")) for r in rows], schema)
        key = F.sha2(F.concat_ws("\0", "judgment", "reasoning", now.cast("string")), 256)
        given = given.withColumn("id", F.coalesce("id", F.substring(key, 1, 32))).withColumn("created_at", now).withColumn("updated_at", now)

        def plan(state: State) -> dict[str, DataFrame]:
            t = self.tables
            records = store.upsert_by_id(t.read("records", state), store.insert(self.spark.createDataFrame([], MEMORY_RECORD), given.drop("tags")))
            dim, rel = store.replace_tags(t.read("global_tags", state), t.read("memory_tag_rel", state), given.select("id", "tags"))
            return {"records": records, "global_tags": dim, "memory_tag_rel": rel}

        self._change_memories(plan)

    def _nearest(self, query: str, k: int) -> DataFrame | None:
        """The nearest vectors, if there is an index of this store's space."""
        if self.embed is None:
            return None
        state = self.tables.state()
        if not self._index_of(state):
            state = self.follow()
        if self._index_of(state)["space"] != self.space:
            return None
        q = self.spark.createDataFrame([(query,)], "t string").select(self.embed(F.col("t")).alias("e")).first()["e"]
        cells = self._cells_at(state)
        return cells.top_k(q, k) if cells else retrieval.vector_top_k(self._vectors_at(state), "item_id", "embedding", q, k)

    def recall(self, query: str, limit: int = 10, scope: str = PUBLIC, entities: list[str] | None = None, per_type: int | None = None) -> DataFrame:
        """Memories for a query; with entities or a quota by type, chained recall."""
        vectors, now = self._nearest(query, 3 * limit), time.time()
        if entities or per_type:
            return retrieval.chained_recall(self.memories(), query, entities or [], per_type or limit, limit, scope, now, vectors)
        return retrieval.comprehensive_recall(self.memories(), query, limit, scope, now, vectors, self.scorer)

    def feedback(self, useful: list[str], recalled: list[str], actions: list[dict], scope: str = PUBLIC) -> None:
        ids = lambda x: self.spark.createDataFrame([(i,) for i in x], "id string")
        schema = "action_no int, action string, source_memory_ids array<string>, memory struct<type:string,judgment:string,reasoning:string,tags:array<string>>"
        rows = [(n, a.get("action"), a.get("source_memory_ids"), tuple((a.get("memory") or {}).get(k) for k in ("type", "judgment", "reasoning", "tags")) if a.get("memory") else None) for n, a in enumerate(actions)]
        acts = lifecycle.normalize_actions(self.spark.createDataFrame(rows, schema))
        now = time.time()

        def plan(state: State) -> dict[str, DataFrame]:
            new = lifecycle.feedback(self.tables.read("records", state), ids(useful), ids(recalled), acts, now, scope, self.decay)
            return {"records": new, "memory_tag_rel": _links_of(self.tables.read("memory_tag_rel", state), new)}

        self._change_memories(plan)

    def restore(self, rows: DataFrame) -> None:
        """Takes in a batch of records keyed by judgment (record columns and seq), as from a backup; links of memories that it displaced go."""

        def plan(state: State) -> dict[str, DataFrame]:
            records = lifecycle.upsert_by_judgment(self.tables.read("records", state), rows).drop("outcome")
            return {"records": records, "memory_tag_rel": _links_of(self.tables.read("memory_tag_rel", state), records)}

        self._change_memories(plan)

    def delete(self, ids: list[str]) -> None:
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")

        def plan(state: State) -> dict[str, DataFrame]:
            records, rel = store.delete(self.tables.read("records", state), self.tables.read("memory_tag_rel", state), gone)
            return {"records": records, "memory_tag_rel": rel}

        self._change_memories(plan)

    def browse(self, page: int = 1, size: int = 20, keyword: str = "", scope: str | None = None) -> DataFrame:
        m = self.memories()
        m = browse.keyword_filter(m, keyword) if keyword else m
        m = m.filter(retrieval.scope_filter(scope)) if scope else m
        return ranking.page(m, [F.desc("created_at"), F.desc("strength"), F.col("id")], page, size)

    def overview(self) -> DataFrame:
        state = self.tables.state()
        return browse.overview(*[self.tables.read(n, state) for n in SOURCES])

    def profiles(self) -> DataFrame:
        return browse.profile_stats(self.memories())

    # -- notes

    def sync_notes(self, folder: str) -> None:
        """Brings chunks and registry to what the folder holds."""
        disk = files.read_notes(self.spark, folder)
        facts = disk.select(F.col("relative_path").alias("source_id"), F.col("relative_path").alias("source_file_path"), F.col("content"), F.col("file_timestamp").cast("double").alias("updated_at"))
        facts = facts.filter(F.trim("content") != "").select("source_id", "source_file_path", text.first_heading(F.col("content")).alias("heading"), text.line_count(F.col("content")).alias("total_lines"), "updated_at")

        def plan(state: State) -> tuple[dict[str, DataFrame], dict]:
            old, stored = self.tables.read("note_registry", state), self.tables.read("note_chunks", state)
            index = old.select(F.col("source_file_path").alias("relative_path"), F.col("updated_at").cast("long").alias("file_timestamp"))
            chunks, _ = notes.sync_chunks(stored, index, disk)
            first = int(state.properties.get("next_note", 0))
            registry = store.register_notes(old, facts, first).join(disk.select(F.col("relative_path").alias("source_file_path")), "source_file_path", "left_semi")
            top = registry.agg(F.max("note_short_id")).first()[0]
            touched = notes.file_diff(index, disk).filter("change != 'unchanged'").select(F.col("relative_path").alias("file_id"))
            held = self._chunk_index(state)
            if held.segments:
                fresh = chunks.join(touched, "file_id", "left_semi")
                held = held if touched.isEmpty() else held.replace(fresh, touched)
            else:
                held = held.build(chunks)
            if len(held.segments) > MOST_SEGMENTS:
                held = held.compact()
            properties = {"chunk_index": json.dumps(held.segments), "next_note": str(max(first, -1 if top is None else top + 1))}
            return {"note_chunks": chunks, "note_registry": registry}, properties

        self._change(plan)

    def _chunk_index(self, state: State) -> ChunkIndex:
        return ChunkIndex(self.spark, f"{self.tables.root}/chunk_index", json.loads(state.properties.get("chunk_index", "[]")))

    def rebuild_chunk_index(self) -> None:
        """The chunk index made anew of all stored chunks."""
        self._change(lambda state: ({}, {"chunk_index": json.dumps(self._chunk_index(state).build(self.tables.read("note_chunks", state)).segments)}))

    def clear_notes(self) -> None:
        """No notes; their numbers start at 0 again."""
        empty = {n: self.spark.createDataFrame([], TABLES[n]) for n in ("note_chunks", "note_registry")}
        self._change(lambda state: (empty, {"chunk_index": None, "next_note": None}))

    def recall_notes(self, query: str, limit: int = 12) -> DataFrame:
        state = self.tables.state()
        index = self._chunk_index(state)
        found = retrieval.note_search(self.tables.read("note_chunks", state), query, limit, scorer=self.scorer, index=index if index.segments else None)
        return store.with_short_ids(found.filter(text.contains_any_part(F.col("content"), F.lit(query))), self.tables.read("note_registry", state))

    def read_note(self, folder: str, path: str, offset: int = 0, limit: int = 2000) -> DataFrame:
        note = files.read_notes(self.spark, folder).filter(F.col("relative_path") == path).select(F.col("relative_path").alias("file_id"), "content")
        return notes.budget_page(note, offset, limit)

    def create_note(self, folder: str, title: str, body: str) -> str:
        one = self.spark.createDataFrame([(title, body)], "t string, b string")
        r = one.select(text.note_file_name(F.col("t"), F.current_timestamp()).alias("name"), text.note_body(F.col("t"), F.col("b")).alias("body")).first()
        return files.write_note(self.spark, folder, r["name"], r["body"])

    # -- maintenance

    def sleep(self, backup: str | None = None) -> None:
        """Migration, scope repair, consolidation and clean-up of links in one commit; then the vector index is brought up to date, and a backup is made of
        which three are kept."""
        now = time.time()

        def plan(state: State) -> dict[str, DataFrame]:
            records = store.backfill_scope(store.migrate(self.tables.read("records", state)))
            kept, rel = lifecycle.consolidate(records, self.tables.read("memory_tag_rel", state), now, self.decay)
            return {"memory_tag_rel": _links_of(rel, kept), "records": kept}

        self._change_memories(plan)
        state = self.follow()
        if backup:
            store.export_snapshot(*[self.tables.read(n, state) for n in SOURCES], f"{backup}/{time.strftime('%Y%m%d')}")
            files.prune_backup_folders(self.spark, backup)
