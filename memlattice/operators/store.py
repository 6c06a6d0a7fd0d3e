"""The truth store: memories, tags and their links, the note registry and snapshots, as snapshot-to-snapshot transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions.tags import normalize_tags
from memlattice.functions.text import normal_path, vector_text
from memlattice.operators.ranking import first_wins
from memlattice.schemas import MEMORY_RECORD, MEMORY_TYPES, PUBLIC
from memlattice.session import cut_lineage


def insert(records: DataFrame, new: DataFrame) -> DataFrame:
    """New memories, missing columns filled: id by uuid, strength 10, passive, public."""
    defaults = {
        "id": F.expr("uuid()"), "memory_type": F.lit(MEMORY_TYPES["knowledge"]), "judgment": F.lit(""), "reasoning": F.lit(""), "strength": F.lit(10), "is_active": F.lit(False),
        "useful_count": F.lit(0), "useful_score": F.lit(0.0), "last_recalled_at": F.lit(0.0), "last_decay_at": F.lit(0.0), "created_at": F.lit(0.0), "updated_at": F.lit(0.0), "memory_scope": F.lit(PUBLIC),
    }
    cols = []
    for f in MEMORY_RECORD.fields:
        c = F.coalesce(F.col(f.name), defaults[f.name]) if f.name in new.columns else defaults[f.name]
        cols.append((F.trim(c) if f.name in ("judgment", "reasoning", "memory_scope") else c).cast(f.dataType).alias(f.name))
    return records.unionByName(new.select(*cols))


def upsert_by_id(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those of their id whole."""
    return records.join(rows.select("id"), "id", "left_anti").select(*records.columns).unionByName(rows.select(*records.columns))


def delete(records: DataFrame, bridge: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories gone with their tag links (indexes are derived from what is left)."""
    return records.join(ids, "id", "left_anti"), bridge.join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_anti")


def tag_dimension(tagged: DataFrame) -> DataFrame:
    """(id, name) of all tags in the tables (id, tags), numbered from 1 by name."""
    names = tagged.select(F.explode(normalize_tags(F.col("tags"))).alias("name")).distinct()
    return number(names, [F.col("name")], "id", 1)


def number(rows: DataFrame, order: list[Column], name: str, start: int) -> DataFrame:
    """Consecutive numbers in order: a range sort, counts of its partitions, and the running total of those counts.

    Only the counts, one row a partition, meet in one task.  The sorted rows are written down, since a second range partitioning of them, by other
    samples, may have other bounds than the one that was counted.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    offset = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__o", offset).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    out = ranged.withColumn("__i", inside).join(F.broadcast(counts), "__p")
    return out.withColumn(name, (F.col("__o") + F.col("__i") + (start - 1)).cast("long")).drop("__p", "__i", "__o")


def bind_tags(dimension: DataFrame, bridge: DataFrame, tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags and links after the memories (id, tags) got theirs: known names keep their ids, new ones follow the highest."""
    pairs = tagged.select(F.col("id").alias("memory_id"), F.explode(normalize_tags(F.col("tags"))).alias("name"))
    fresh = number(pairs.select("name").distinct().join(dimension, "name", "left_anti"), [F.col("name")], "n", 1)
    top = dimension.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    grown = dimension.select("id", "name").unionByName(fresh.crossJoin(F.broadcast(top)).select((F.col("top") + F.col("n")).alias("id"), "name"))
    links = pairs.join(grown, "name").select("memory_id", F.col("id").alias("tag_id"))
    return grown, bridge.unionByName(links).dropDuplicates(["memory_id", "tag_id"])


def replace_tags(dimension: DataFrame, bridge: DataFrame, tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    rest = bridge.join(tagged.select(F.col("id").alias("memory_id")), "memory_id", "left_anti")
    return bind_tags(dimension, rest.select("memory_id", "tag_id"), tagged)


def names_to_ids(dimension: DataFrame, asked: DataFrame) -> DataFrame:
    """(pos, name, id) for a list of names in its order, new names numbered after the highest."""
    grown, _ = bind_tags(dimension, dimension.sparkSession.createDataFrame([], "memory_id string, tag_id long"), asked.select(F.lit("").alias("id"), F.array("name").alias("tags")))
    return asked.join(grown, "name").orderBy("pos").select("pos", "name", "id")


def ids_to_names(dimension: DataFrame, asked: DataFrame) -> DataFrame:
    """(pos, id, name) for a list of ids in its order, unknown ones dropped."""
    return asked.join(dimension, "id").orderBy("pos").select("pos", "id", "name")


def tags_of(dimension: DataFrame, bridge: DataFrame) -> DataFrame:
    """(id, tags) sorted by name."""
    linked = bridge.join(dimension.withColumnRenamed("id", "tag_id"), "tag_id")
    return linked.groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("tags"))


def with_tags(records: DataFrame, dimension: DataFrame, bridge: DataFrame) -> DataFrame:
    """All memories with their tags, none where there are none."""
    return records.join(tags_of(dimension, bridge), "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def newest_first(tagged: DataFrame) -> DataFrame:
    """All memories for a back-fill of vectors, newest first."""
    return tagged.orderBy(F.desc("created_at"), "id")


def memory_ids(records: DataFrame) -> DataFrame:
    """All ids, oldest first."""
    return records.select("id", "created_at").orderBy("created_at", "id").select("id")


def note_by_short_id(registry: DataFrame, short_id: int) -> DataFrame:
    """The note with that number, if there is one."""
    return registry.filter(F.col("note_short_id") == short_id).limit(1)


def allocate_file_ids(index: DataFrame, paths: DataFrame) -> DataFrame:
    """The file index (id, relative_path) with ids for paths that have none yet: after the highest, in path order."""
    wanted = paths.select("relative_path").distinct().join(index.select("relative_path"), "relative_path", "left_anti")
    top = index.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = number(wanted, [F.col("relative_path")], "n", 1).crossJoin(F.broadcast(top))  # one row
    return index.select("id", "relative_path").unionByName(fresh.select((F.col("top") + F.col("n")).alias("id"), "relative_path"))


def memories_by_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id").distinct(), "id", "left_semi")


def vector_index_rows(tagged: DataFrame) -> DataFrame:
    """(item_id, vector_text) of memories that have a text to embed."""
    return tagged.select(F.col("id").alias("item_id"), vector_text(F.col("judgment"), F.col("tags")).alias("vector_text")).filter("vector_text != ''")


def all_tag_names(dimension: DataFrame) -> DataFrame:
    return dimension.select(F.trim("name").alias("name")).filter("name != ''").distinct()


def register_notes(registry: DataFrame, notes: DataFrame, first: int = 0) -> DataFrame:
    """The note registry after an upsert (source_id, source_file_path, heading, total_lines, updated_at).

    A short id is taken over by source id, else by path, else comes after the highest, from ``first`` on (so that numbers of deleted notes are
    not given again); rows that the new ones displace go.
    """
    new = notes.withColumn("source_file_path", normal_path(F.col("source_file_path")))
    by_id = registry.select("source_id", F.col("note_short_id").alias("a"))
    by_path = registry.groupBy("source_file_path").agg(F.min("note_short_id").alias("b"))
    known = new.join(by_id, "source_id", "left").join(by_path, "source_file_path", "left").withColumn("note_short_id", F.coalesce("a", "b")).drop("a", "b")
    top = registry.agg(F.greatest(F.max("note_short_id"), F.lit(first - 1)).alias("top"))
    fresh = number(known.filter("note_short_id is null").drop("note_short_id"), [F.col("source_file_path")], "n", 1)
    fresh = fresh.crossJoin(F.broadcast(top)).withColumn("note_short_id", F.col("top") + F.col("n")).drop("top", "n")
    all_new = known.filter("note_short_id is not null").unionByName(fresh)
    rest = registry.join(all_new.select("source_id"), "source_id", "left_anti").join(all_new.select("source_file_path"), "source_file_path", "left_anti").join(all_new.select("note_short_id"), "note_short_id", "left_anti")
    return rest.select(*registry.columns).unionByName(all_new.select(*registry.columns))


def short_ids_of_paths(registry: DataFrame, paths: DataFrame) -> DataFrame:
    """(source_file_path, note_short_id): the lowest of a path."""
    return registry.join(paths.select("source_file_path").distinct(), "source_file_path", "left_semi").groupBy("source_file_path").agg(F.min("note_short_id").alias("note_short_id"))


def with_short_ids(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """note_short_id by path, else by file id, else -1."""
    by_path = registry.groupBy("source_file_path").agg(F.min("note_short_id").alias("a"))
    by_id = registry.groupBy(F.col("source_id").alias("file_id")).agg(F.min("note_short_id").alias("b"))
    return rows.join(by_path, "source_file_path", "left").join(by_id, "file_id", "left").withColumn("note_short_id", F.coalesce("a", "b", F.lit(-1)).cast("long")).drop("a", "b")


def ordinal_ids(records: DataFrame, start: int = 10000) -> DataFrame:
    """(id, short_id) by age."""
    return number(records.select("id", "created_at"), [F.col("created_at"), F.col("id")], "short_id", start).select("id", "short_id")


def full_ids(asked: DataFrame, memories: DataFrame, order: list[Column]) -> DataFrame:
    """(pos, short_id, id): for short ids (pos, short_id), prefixes of ids, the first memory in ``order`` that has the prefix; unknown ones are left out.

    Ids are cut to the few lengths that are asked for, so that prefixes meet in an equality join.
    """
    lengths = [r["n"] for r in asked.select(F.char_length("short_id").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return asked.select("pos", "short_id", F.lit(None).cast("string").alias("id"))
    ranked = memories.select("id", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("place"))
    cut = ranked.filter(F.char_length("id") >= lengths[0]).select("id", "place", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n"))
    cut = cut.filter(F.char_length("id") >= F.col("n")).select(F.expr("left(id, n)").alias("short_id"), F.struct("place", "id").alias("x"))
    first = cut.join(asked.select("short_id").distinct(), "short_id", "left_semi").groupBy("short_id").agg(F.min("x")["id"].alias("id"))
    return asked.join(first, "short_id").select("pos", "short_id", "id")


def unregister_notes(registry: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is left of the registry, source ids that went) after the notes of some paths are deleted."""
    paths = files.select("source_file_path").distinct()
    return registry.join(paths, "source_file_path", "left_anti").select(*registry.columns), registry.join(paths, "source_file_path", "left_semi").select("source_id")


def ephemeral_ids(rows: DataFrame, order: list[Column]) -> DataFrame:
    """short_id m0, m1 ... over a (short) ranked list."""
    return rows.withColumn("short_id", F.concat(F.lit("m"), F.row_number().over(Window.orderBy(*order)) - 1))


def export_snapshot(records: DataFrame, dimension: DataFrame, bridge: DataFrame, path: str) -> None:
    """records/, global_tags/ and memory_tag_rel/ as JSON lines in id order, each written by all tasks."""
    for name, df, order in (("records", records, ["id"]), ("global_tags", dimension, ["id"]), ("memory_tag_rel", bridge, ["memory_id", "tag_id"])):
        df.orderBy(*order).write.mode("overwrite").json(f"{path}/{name}")


def import_snapshot(records: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store with the incoming rows whose id is new, and (inserted, skipped, failed): a row without id or judgment fails."""
    good = incoming.filter("coalesce(id, '') != '' and coalesce(trim(judgment), '') != ''")
    good = first_wins(good, ["id"], [F.desc("created_at"), F.col("judgment")])
    new = good.join(records.select("id"), "id", "left_anti")
    bad = F.count_if(F.expr("coalesce(id, '') = '' or coalesce(trim(judgment), '') = ''"))
    counts = incoming.agg(F.count("*").alias("n"), bad.alias("failed")).crossJoin(new.agg(F.count("*").alias("inserted")))
    counts = counts.select("inserted", (F.col("n") - F.col("failed") - F.col("inserted")).alias("skipped"), "failed")
    return insert(records, new), counts


def backfill_scope(records: DataFrame) -> DataFrame:
    scope = F.trim(F.coalesce("memory_scope", F.lit("")))
    return records.withColumn("memory_scope", F.when(scope == "", F.lit(PUBLIC)).otherwise(scope))


def drop_deprecated(records: DataFrame, names: list[str]) -> DataFrame:
    return records.drop(*names)


def migrate(records: DataFrame) -> DataFrame:
    """A stored table of any age with all of today's columns."""
    return insert(records.sparkSession.createDataFrame([], MEMORY_RECORD), records)


def from_collection(rows: DataFrame) -> DataFrame:
    """Rows of an old vector collection (id, document, judgment, reasoning) as records: the document is the judgment if there is none,
    and the reasoning if it differs; rows without text go."""
    judgment = F.coalesce(F.when(F.trim("judgment") != "", F.trim("judgment")), F.trim("document"), F.lit(""))
    reasoning = F.coalesce(F.when(F.trim("reasoning") != "", F.trim("reasoning")), F.when(F.trim("document") != judgment, F.trim("document")), F.lit(""))
    return rows.select("id", judgment.alias("judgment"), reasoning.alias("reasoning"), "created_at").filter("judgment != ''")


def decode_memory(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Memory dictionaries (JSON text in ``value``) with today's or old field names."""
    x = F.from_json("value", "id string, judgment string, content string, emotion_type string, reasoning string, strength int, tags string, memory_type string, created_at double")
    x = rows.select(x.alias("x"))
    return x.select(
        "x.id", F.coalesce("x.judgment", "x.content", "x.emotion_type", F.lit("")).alias("judgment"), F.coalesce("x.reasoning", F.lit("")).alias("reasoning"),
        F.coalesce("x.strength", F.lit(1)).alias("strength"), F.coalesce("x.memory_type", F.lit(MEMORY_TYPES["knowledge"])).alias("memory_type"), F.coalesce("x.created_at", F.lit(0.0)).alias("created_at"),
    )
