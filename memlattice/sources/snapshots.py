"""JSON snapshots, read and written by all tasks whatever the size of a file.

A file is read as the pieces between its closing braces, so that Spark may split it anywhere.  Three things are carried from piece to piece, each a
running total inside a split on top of the totals of the splits before it: whether a string is open, how deep the piece begins, and which array of
the document it is in.  Where objects begin and end follows from these, and only the pieces of one record ever meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from memlattice.session import cut_lineage

RECORD = (
    "id string, memory_type string, judgment string, reasoning string, tags array<string>, strength int, is_active boolean, useful_count int, "
    "useful_score double, last_recalled_at double, last_decay_at double, created_at double, updated_at double, memory_scope string"
)
#: Arrays that hold records; the later one by name goes first if a document has both.
ARRAYS = ("memories", "records")
_SPLIT = ["file", "block"]
_EARLIER = (Window.unboundedPreceding, -1)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON snapshots of any of three shapes: {records: [...]}, {memories: [...]} or a bare list.

    Other keys may stand anywhere, objects among them.  Fields that are missing or of another type are null; what no object holds is passed over.
    """
    rows = _sections(_depths(_strings(_pieces(spark, path))))
    number = _before(rows, "number", F.col("start").isNotNull().cast("int"))
    inside = number.filter((F.col("depth") > F.col("base")) | F.col("start").isNotNull())
    text = F.concat(F.when(F.col("start").isNotNull(), F.expr("substr(raw, start)")).otherwise(F.col("raw")), F.lit("}"))
    nth = F.col("number") + F.col("start").isNotNull().cast("int")
    pieces = F.array_sort(F.collect_list(F.struct("block", "at", text.alias("text"))))
    whole = inside.groupBy("file", nth.alias("nth")).agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("value"))
    return whole.select(F.from_json("value", RECORD).alias("r")).select("r.*")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, raw, base): base is the depth at which records lie, 1 in a bare list and 2 in an object."""
    rows = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    heads = rows.groupBy("file").agg(F.min_by("raw", F.struct("block", "at")).alias("head"))
    base = F.when(F.col("head").rlike(r"^[\s\x{FEFF}]*\["), 1).otherwise(2)
    return rows.join(F.broadcast(heads.select("file", base.alias("base"))), "file")  # a row a file


def _along(rows: DataFrame, column: str, name: str, fill: bool = False) -> DataFrame:
    """``rows`` with the total of a column over the pieces of the same split that come before, or (``fill``) its last value that is not null, the piece's own included.

    A split is read by one task from begin to end, and until the pieces of records meet no row changes its place, so nothing is shuffled for this.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carry, latest = None, None if fill else 0, -1
        for b in batches:
            if not b.num_rows:
                continue
            n, block, at = b.num_rows, b["block"].to_numpy(), b["at"].to_numpy()
            if at[0] <= latest or (at[1:] <= at[:-1]).any():
                raise ValueError("pieces are out of order")
            latest = at[-1]
            file = b["file"].dictionary_encode().indices.to_numpy()
            starts = np.concatenate([[0], 1 + np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1]))])
            own = np.repeat(starts, np.diff([*starts, n]))  # where the split of each piece begins
            same = (own == 0) & ((b["file"][0].as_py(), block[0]) == key)  # the split of the batch before goes on
            if fill:
                found = np.maximum.accumulate(np.where(b[column].is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
                none = found < own
                values = b[column].take(pa.array(found, mask=none))
                new = values if carry is None else pc.if_else(pa.array(none & same), pa.scalar(carry, values.type), values)
                carry = new[n - 1].as_py()
            else:
                value = pc.fill_null(b[column], 0).to_numpy().astype(np.int64)
                before = np.cumsum(value) - value
                before = before - before[own] + np.where(same, carry, 0)
                carry, new = int(before[-1] + value[-1]), pa.array(before)
            key = (b["file"][n - 1].as_py(), block[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, new], [*b.schema.names, name])

    kind = rows.schema[column].dataType if fill else LongType()
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, kind)]))


def _blocks():
    """The splits of a file in their order, a row each."""
    return Window.partitionBy("file").orderBy("block")


def _before(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with the total of ``value`` over all pieces of the file that come before."""
    blocks = rows.groupBy(*_SPLIT).agg(F.sum(value).alias("n"))
    blocks = blocks.select(*_SPLIT, F.coalesce(F.sum("n").over(_blocks().rowsBetween(*_EARLIER)), F.lit(0)).alias("n"))
    here = _along(rows.withColumn("__value", value.cast("long")), "__value", "__here")
    return here.join(F.broadcast(blocks), _SPLIT).withColumn(name, F.col("n") + F.col("__here")).drop("n", "__value", "__here")  # blocks: a row a split


def _count(column: str | Column, characters: str) -> Column:
    return F.length(column) - F.length(F.translate(column, characters, ""))


def _strings(rows: DataFrame) -> DataFrame:
    """Adds ``marks``, the brackets and opening braces outside strings, and ``net``, by how much the piece is deeper at its end.

    Of a mark the character, the number of characters since the one before (itself counted) and the name in ARRAYS whose array it opens.  They are found in ``code``, the
    piece with its strings blanked but for these names.  A brace after a backslash is no JSON, so an escape never reaches over the end of a piece.
    """
    plain = F.regexp_replace("raw", r"(?s)\\.", "__")  # made twice, so that it does not travel
    rows = _before(rows.withColumn("quotes", _count(plain, '"')), "quoted", F.col("quotes"))
    part = lambda x, i: F.when((i + F.col("quoted")) % 2 == 0, x).when(x.isin(*ARRAYS), x).otherwise(F.repeat(F.lit("_"), F.length(x)))
    rows = rows.withColumn("code", F.array_join(F.transform(F.split(plain, '"', -1), part), '"'))
    closed = ((F.col("quoted") + F.col("quotes")) % 2 == 0).cast("int")
    mark = lambda s: F.struct(F.right(s, F.lit(1)).alias("mark"), F.length(s).alias("length"), F.regexp_extract(s, r'"(memories|records)"\s*:\s*\[$', 1).alias("name"))
    rows = rows.withColumn("marks", F.transform(F.regexp_extract_all("code", F.lit(r"([^\[\]{]*[\[\]{])"), F.lit(1)), mark))
    return cut_lineage(rows.withColumn("net", _count("code", "[{") - _count("code", "]") - closed).drop("code", "quotes", "quoted"))


def _depths(rows: DataFrame) -> DataFrame:
    """Adds ``depth`` at the begin of the piece, ``start`` (the place of the brace that opens an object at depth ``base``), ``section`` (the last array of the
    document that begins in the piece, empty for other values) and ``seen`` (the greatest of these).  An open record has no other within, so a piece has one start at most."""
    rows = _before(rows, "depth", F.col("net"))

    def step(a: Column, s: Column) -> Column:
        at, opens = a["at"] + s["length"], s["mark"] != "]"
        named = F.when((a["depth"] == 1) & opens, s["name"]).otherwise(a["section"])
        start = F.when((s["mark"] == "{") & (a["depth"] == F.col("base")), at).otherwise(a["start"])
        return F.struct((a["depth"] + F.when(opens, 1).otherwise(-1)).alias("depth"), at.alias("at"), start.alias("start"), named.alias("section"), F.greatest(a["seen"], named).alias("seen"))

    none = F.lit(None).cast("string")
    begin = F.struct(F.col("depth").alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("start"), none.alias("section"), none.alias("seen"))
    found = F.aggregate("marks", begin, step)
    return cut_lineage(rows.withColumn("f", found).select("file", "block", "at", "raw", "base", "depth", "f.start", "f.section", "f.seen"))


def _sections(rows: DataFrame) -> DataFrame:
    """The pieces in the array that holds the records."""
    blocks = rows.groupBy(*_SPLIT).agg(F.max_by("section", F.when(F.col("section").isNotNull(), F.col("at"))).alias("s"), F.max("seen").alias("seen"))
    blocks = blocks.select(*_SPLIT, F.last("s", True).over(_blocks().rowsBetween(*_EARLIER)).alias("s"), F.max("seen").over(Window.partitionBy("file")).alias("holds"))
    rows = _along(rows.drop("seen"), "section", "here", fill=True).join(F.broadcast(blocks), _SPLIT)
    rows = rows.withColumn("section", F.coalesce("here", "s")).drop("here")
    return rows.filter((F.col("base") == 1) | ((F.col("section") == F.col("holds")) & F.col("section").isin(*ARRAYS))).drop("s", "holds")


def write_snapshot(tables: dict[str, DataFrame], path: str, files: int, exported_at: float = 0.0) -> None:
    """``tables`` by name as ``files`` JSON documents, each with a share of the rows of every table; a row is a line, and no task gathers a document."""
    spark, names = next(iter(tables.values())).sparkSession, list(tables)
    frame = spark.range(files).select(F.col("id").cast("int").alias("bucket"), F.explode(F.array(*[F.lit(k) for k in range(len(names))])).alias("section"))
    name = F.array(*[F.lit(n) for n in names])[F.col("section")]
    head = F.concat(F.when(F.col("section") == 0, F.lit(f'{{"schema_version":1,"exported_at":{exported_at!r},')).otherwise(F.lit("")), F.lit('"'), name, F.lit('":['))
    foot = F.when(F.col("section") == len(names) - 1, F.lit("]}")).otherwise(F.lit("],"))
    lines = frame.select("bucket", "section", F.lit(0).alias("kind"), head.alias("value")).unionByName(frame.select("bucket", "section", F.lit(2).alias("kind"), foot.alias("value")))
    for k, df in enumerate(tables.values()):
        row = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
        lines = lines.unionByName(row.select(F.pmod(F.xxhash64("value"), F.lit(files)).cast("int").alias("bucket"), F.lit(k).alias("section"), F.lit(1).alias("kind"), "value"))
    order = Window.partitionBy("bucket", "section").orderBy("kind", "value")
    dealt = lines.repartition(files, "bucket").withColumn("nth", F.row_number().over(order))
    line = F.when((F.col("kind") == 1) & (F.col("nth") > 2), F.concat(F.lit(","), F.col("value"))).otherwise(F.col("value"))
    dealt.sortWithinPartitions("bucket", "section", "nth").select("bucket", line.alias("value")).write.mode("overwrite").partitionBy("bucket").text(path)
