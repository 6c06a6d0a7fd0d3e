"""Notes: chunking, incremental file index, line paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions.text import first_heading, line_count
from memlattice.operators.ranking import first_wins
from memlattice.schemas import FILE_INDEX_VERSION

MAX_CHUNK_CHARS = 220


#: Lines folded at a time: what a fold has found is copied at every step, so a long note is folded in slices.
SLICE = 256
#: Kinds of line, and what a chunk that is open consists of.
_TEXT, _ROW, _CODE, _BARE, _BLANK, _NOTHING = 1, 2, 3, 4, 5, 0
BLANK = r"^[\x09-\x0D\x1C-\x20\x85\p{Z}]*$"
_SPANS = "array<struct<a:int,b:int>>"
_STATE = f"struct<kind:int,at:int,size:int,spans:{_SPANS}>"
_WHOLE = f"struct<kind:int,at:int,size:int,spans:array<{_SPANS}>>"


def _line_kind(line: Column) -> Column:
    fence = F.startswith(line, F.lit("```"))
    bare = fence & F.substring(line, 4, 1 << 30).rlike(BLANK)
    return F.when(bare, _BARE).when(fence, _CODE).when(F.startswith(line, F.lit("|")), _ROW).when(line.rlike(BLANK), _BLANK).otherwise(_TEXT)


def _step(most: int):
    """The state after a line (n from 1, kind, size): what chunk is open since which line, its size, and the spans that were closed.

    Fenced blocks (to the end if unclosed) and runs of table lines are chunks of their own; otherwise a blank line
    ends a chunk, and so does a line that would take it over ``most`` characters.
    """

    def after(s: Column, x: Column) -> Column:
        kind, line = s["kind"], x["kind"]
        coding, fence = kind == _CODE, line.isin(_CODE, _BARE)
        goes_on = ((kind == _ROW) & (line == _ROW)) | ((kind == _TEXT) & (line == _TEXT) & (s["size"] + x["size"] <= most))
        ends = F.when(coding, line == _BARE).otherwise((kind != _NOTHING) & ~goes_on)
        last = F.when(coding, x["n"]).otherwise(x["n"] - 1)
        spans = F.when(ends, F.concat(s["spans"], F.array(F.struct(s["at"].alias("a"), last.alias("b"))).cast(_SPANS))).otherwise(s["spans"])
        stays = (coding & ~ends) | (~coding & goes_on)
        begins = F.when(fence, _CODE).when(line == _BLANK, _NOTHING).otherwise(line)
        new = F.when(stays, kind).when(coding, _NOTHING).otherwise(begins)
        size = F.when(stays, s["size"] + x["size"]).otherwise(x["size"])
        return F.struct(new.alias("kind"), F.when(stays, s["at"]).otherwise(x["n"]).alias("at"), size.alias("size"), spans.alias("spans")).cast(_STATE)

    return after


def chunk_spans(lines: Column, most: int = MAX_CHUNK_CHARS) -> Column:
    """(a, b), first and last line from 1, of the chunks of a note, from its lines: a fold over slices, each a fold over its lines."""
    n = F.size(lines)
    facts = F.transform(lines, lambda line, i: F.struct((i + 1).alias("n"), _line_kind(line).alias("kind"), F.char_length(line).alias("size")))
    slices = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / SLICE).cast("int")), lambda k: F.slice(facts, k * SLICE + 1, SLICE))
    nothing = F.struct(F.lit(_NOTHING).alias("kind"), F.lit(0).alias("at"), F.lit(0).alias("size"))

    def over(s: Column, part: Column) -> Column:
        start = F.struct(s["kind"].alias("kind"), s["at"].alias("at"), s["size"].alias("size"), F.array().cast(_SPANS).alias("spans")).cast(_STATE)
        got = F.aggregate(part, start, _step(most))
        # one more level of lambda, so that the slice is folded once and not once a field
        return F.element_at(F.transform(F.array(got), lambda g: F.struct(g["kind"].alias("kind"), g["at"].alias("at"), g["size"].alias("size"), F.concat(s["spans"], F.array(g["spans"])).alias("spans")).cast(_WHOLE)), 1)

    none = F.struct(nothing["kind"].alias("kind"), nothing["at"].alias("at"), nothing["size"].alias("size"), F.array().cast(f"array<{_SPANS}>").alias("spans")).cast(_WHOLE)
    still = lambda s: F.filter(F.array(F.struct(s["at"].alias("a"), n.alias("b"))), lambda _: s["kind"] != _NOTHING).cast(_SPANS)
    return F.aggregate(slices, none, over, lambda s: F.concat(F.flatten(s["spans"]), still(s)))


def chunk_notes(notes: DataFrame, most: int = MAX_CHUNK_CHARS) -> DataFrame:
    """Chunks of notes (file_id, source_file_path, content), in the JVM and inside the row of the note: nothing is shuffled.

    The first chunk begins with the path, as line 0; a note without text is its path alone.
    """
    path = F.coalesce("source_file_path", F.lit(""))
    rows = notes.select("file_id", "source_file_path", F.split(F.coalesce("content", F.lit("")), "\n", -1).alias("lines"))
    rows = rows.select("file_id", "source_file_path", "lines", chunk_spans(F.col("lines"), most).alias("spans"))
    body = lambda s: F.array_join(F.slice("lines", s["a"], s["b"] - s["a"] + 1), "\n")
    chunk = lambda i, a, b, text: F.struct(i.cast("int").alias("chunk_index"), a.cast("int").alias("line_start"), b.cast("int").alias("line_end"), text.alias("content"))
    each = F.transform("spans", lambda s, i: chunk(i + 1, F.when(i == 0, 0).otherwise(s["a"]), s["b"], F.when(i == 0, F.concat(path, F.lit("\n"), body(s))).otherwise(body(s))))
    alone = F.array(chunk(F.lit(1), F.lit(0), F.lit(0), path))
    return rows.select("file_id", "source_file_path", F.explode(F.when(F.size("spans") > 0, each).otherwise(alone)).alias("c")).select("file_id", "source_file_path", "c.*")


def file_diff(index: DataFrame, disk: DataFrame) -> DataFrame:
    """(relative_path, change): add (new, or later on disk), delete or unchanged, from (relative_path, file_timestamp) tables."""
    i = index.select("relative_path", F.col("file_timestamp").alias("old"))
    d = disk.select("relative_path", F.col("file_timestamp").alias("new"))
    change = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull() | (F.col("new") > F.col("old")), "add").otherwise("unchanged")
    return i.join(d, "relative_path", "full").select("relative_path", change.alias("change"))


def sync_chunks(chunks: DataFrame, index: DataFrame, disk_notes: DataFrame, stored_version: str = FILE_INDEX_VERSION, most: int = MAX_CHUNK_CHARS) -> tuple[DataFrame, DataFrame]:
    """Chunks and file index after the files changed; only changed files are cut again, all if the index is of another version."""
    if stored_version != FILE_INDEX_VERSION:
        chunks, index = chunks.filter(F.lit(False)), index.filter(F.lit(False))
    diff = file_diff(index, disk_notes)
    touched = diff.filter("change != 'unchanged'").select(F.col("relative_path").alias("source_file_path"))
    fresh = disk_notes.join(diff.filter("change = 'add'"), "relative_path", "left_semi").filter(F.trim("content") != "")
    fresh = fresh.select(F.col("relative_path").alias("file_id"), F.col("relative_path").alias("source_file_path"), "content")
    new_chunks = chunks.join(touched, "source_file_path", "left_anti").select("file_id", "source_file_path", "chunk_index", "line_start", "line_end", "content").unionByName(chunk_notes(fresh, most))
    return new_chunks, disk_notes.select("relative_path", "file_timestamp")


def chunks_of_path(chunks: DataFrame, path: str) -> DataFrame:
    """The chunks of a note by its path, in order; the filter reaches the scan."""
    return chunks.filter(F.col("source_file_path") == path).orderBy("chunk_index")


def chunks_of_file(chunks: DataFrame, file_id: str) -> DataFrame:
    """The chunks of a note by its id, in order."""
    return chunks.filter(F.col("file_id") == file_id).orderBy("chunk_index")


def all_chunks(chunks: DataFrame) -> DataFrame:
    """All chunks by path and number, as for a rebuild of the index: a range sort."""
    return chunks.orderBy("source_file_path", "chunk_index")


def file_by_id(index: DataFrame, file_id: int) -> DataFrame:
    return index.filter(F.col("id") == file_id)


def file_by_path(index: DataFrame, path: str) -> DataFrame:
    return index.filter(F.col("relative_path") == path)


def replace_file_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after those of some files are replaced whole."""
    return chunks.join(new.select("file_id").distinct(), "file_id", "left_anti").select(*new.columns).unionByName(new)


def delete_files(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The file index without some paths."""
    return index.join(gone.select("relative_path").distinct(), "relative_path", "left_anti")


def bump_timestamps(index: DataFrame, seen: DataFrame) -> DataFrame:
    """The file index with later timestamps taken over."""
    s = seen.groupBy("relative_path").agg(F.max("file_timestamp").alias("__t"))
    return index.join(s, "relative_path", "left").withColumn("file_timestamp", F.greatest("file_timestamp", F.coalesce("__t", "file_timestamp"))).drop("__t")


def note_facts(notes: DataFrame) -> DataFrame:
    """(file_id, heading, total_lines) of notes."""
    return notes.select("file_id", first_heading(F.col("content")).alias("heading"), line_count(F.col("content")).alias("total_lines"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"), F.count_distinct("file_id").alias("total_files"))


def lines_of(notes: DataFrame) -> DataFrame:
    """(file_id, line_no from 1, line)."""
    return notes.select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("p", "line")).select("file_id", (F.col("p") + 1).alias("line_no"), "line")


def line_page(notes: DataFrame, offset: int, limit: int) -> DataFrame:
    """Lines offset + 1 ... offset + limit of each note."""
    lo = max(0, offset)
    return lines_of(notes).filter(F.col("line_no").between(lo + 1, lo + max(1, limit)))


def budget_page(notes: DataFrame, offset: int, limit: int, most: int = 30000) -> DataFrame:
    """A page of lines within a budget of characters, a line at least, with has_more."""
    total = lines_of(notes).groupBy("file_id").agg(F.max("line_no").alias("n"))
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = line_page(notes, offset, limit).withColumn("used", F.sum(F.char_length("line") + 1).over(w)).withColumn("k", F.count("*").over(w))
    rows = rows.filter((F.col("used") <= most) | (F.col("k") == 1)).join(total, "file_id")
    last = F.max("line_no").over(Window.partitionBy("file_id"))
    return rows.withColumn("has_more", last < F.col("n")).select("file_id", "line_no", "line", "has_more")


def sections(notes: DataFrame) -> DataFrame:
    """(file_id, line_no, line, level, heading, section): every line with the heading it stands under."""
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.regexp_extract("line", r"^(#{1,6}) +(.*)$", 1)
    is_head = head != ""
    rows = lines_of(notes).withColumn("level", F.when(is_head, F.length(head))).withColumn("heading", F.when(is_head, F.regexp_extract("line", r"^(#{1,6}) +(.*)$", 2)))
    return rows.withColumn("section", F.last("heading", True).over(w)).withColumn("section_level", F.last("level", True).over(w))


def by_file(hits: DataFrame) -> DataFrame:
    """Ranked chunks grouped by file, files in order of first appearance: (source_file_path, place, chunk_ids)."""
    g = hits.groupBy("source_file_path").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x"))
    return g.select("source_file_path", F.row_number().over(Window.orderBy("first")).alias("place"), F.array_join(F.col("x.id"), ",").alias("chunk_ids"))


def result_shape(hits: DataFrame) -> DataFrame:
    """Chunk rows as note results: id is file#chunk."""
    return hits.select(F.concat_ws("#", "file_id", "chunk_index").alias("id"), "content", "source_file_path", F.struct("line_start", "line_end").alias("lines"))


def newest_chunks(chunks: DataFrame) -> DataFrame:
    return first_wins(chunks, ["file_id", "chunk_index"], [F.desc("line_end")])
