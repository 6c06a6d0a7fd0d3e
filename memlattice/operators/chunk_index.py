"""The stored index of note chunks: postings in buckets by term, in segments.

A segment is a folder of two tables, ``postings`` (term, field, file_id, chunk_index, length), partitioned by a hash of the term into buckets and sorted by term, and
``files`` (file_id, chunks, and for each field the sum of its lengths), small.  A segment *speaks for* the files that it lists: what earlier segments hold
of them is dead, so a file with 0 chunks is a tombstone.  Replacing or deleting a file writes a small segment with its own postings alone; a search
reads the asked terms' buckets of all segments and keeps what the last word on a file says.  ``compact`` makes one segment of all.

Statistics are exact at any time: chunks and lengths are sums over the last words, document frequencies are counted over the living postings of the asked terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlattice.functions import text

FIELDS = ("content", "source_file_path")
BUCKETS = 64
#: Segments from which on a commit compacts.
MOST_SEGMENTS = 8
#: Parts a bucket up to which these are copied as they lie, and files whose numbers travel with tasks; beyond either, postings are dealt anew.
MOST_PARTS, MOST_FILES = 16, 100_000
POSTINGS = "term string, field int, file_id string, chunk_index long, length int, bucket int"
FILES = "file_id string, chunks long, total0 long, total1 long"


def bucket_of(term, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def chunk_postings(chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_index, field, length, terms) of chunks, a row a field; each chunk is tokenised once."""
    each = F.array(*[F.struct(F.lit(i).alias("field"), text.index_tokens(F.col(f)).alias("terms")) for i, f in enumerate(FIELDS)])
    return chunks.select("file_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.explode(each).alias("x")).select("file_id", "chunk_index", "x.field", F.size("x.terms").alias("length"), "x.terms")


class ChunkIndex:
    """Segments below a folder; ``segments`` are their names, oldest first.  An index is a value: every change returns another one."""

    def __init__(self, spark: SparkSession, root: str, segments: Iterable[str] = (), buckets: int = BUCKETS):
        self.spark, self.root, self.segments, self.buckets = spark, root.rstrip("/"), tuple(segments), buckets

    # -- writing

    def _write(self, chunks: DataFrame, gone: DataFrame | None = None) -> str:
        name = uuid.uuid4().hex
        base = f"{self.root}/{name}"
        post = chunk_postings(chunks).select(F.explode("terms").alias("term"), "field", "file_id", "chunk_index", "length")
        self._store(post, f"{base}/postings")
        # terms of a chunk are distinct, so the lengths of a file add up to its postings: what was written is counted and no text tokenised again
        written = self.spark.read.schema(POSTINGS).parquet(f"{base}/postings").groupBy(F.col("file_id").alias("file")).agg(*[F.count_if(F.col("field") == i).alias(f"total{i}") for i in range(len(FIELDS))])
        files = chunks.groupBy("file_id").agg(F.count("*").alias("chunks")).join(written, F.col("file_id").eqNullSafe(F.col("file")), "left")
        files = files.select("file_id", "chunks", *[F.coalesce(f"total{i}", F.lit(0)).alias(f"total{i}") for i in range(len(FIELDS))])
        if gone is not None:
            dead = gone.select("file_id").distinct().join(chunks.select("file_id").distinct(), "file_id", "left_anti")
            files = files.union(dead.select("file_id", *[F.lit(0).cast("long") for _ in range(1 + len(FIELDS))]))
        files.write.parquet(f"{base}/files")
        return name

    def _store(self, post: DataFrame, path: str) -> None:
        """Buckets are folders; a bucket with a very common term is spread over several tasks by the chunk."""
        dealt = post.withColumn("bucket", bucket_of("term", self.buckets))
        spread = F.pmod(F.xxhash64("file_id", "chunk_index"), F.lit(4))
        # terms are told apart by the first bytes that a sort keeps beside its pointers, buckets by their number: two such sorts are quicker than one by both
        sorted_terms = dealt.repartition("bucket", spread).sortWithinPartitions("term")
        sorted_terms.write.partitionBy("bucket").parquet(path)

    def build(self, chunks: DataFrame) -> ChunkIndex:
        """An index of these chunks alone."""
        return self._with([self._write(chunks)])

    def replace(self, chunks: DataFrame, deleted: DataFrame | None = None) -> ChunkIndex:
        """The index after the files of ``chunks`` have these chunks and no others, and the files of ``deleted`` none."""
        return self._with([*self.segments, self._write(chunks, deleted)])

    def delete(self, files: DataFrame) -> ChunkIndex:
        return self.replace(self.spark.createDataFrame([], "file_id string, source_file_path string, chunk_index long, content string"), files)

    def compact(self) -> ChunkIndex:
        """The same index in one segment: living postings are copied, no text is read."""
        if len(self.segments) < 2:
            return self
        name = uuid.uuid4().hex
        last, rows = self.files(), self._each("postings", POSTINGS)
        if len(rows.inputFiles()) <= MOST_PARTS * self.buckets and last.count() <= MOST_FILES:
            # a task writes a part for each bucket that it reads of: about as many parts as there were, and nothing is shuffled
            living = rows.join(F.broadcast(last.select("file_id", "segment")), ["file_id", "segment"], "left_semi")
            living.select("term", "field", "file_id", "chunk_index", "length", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}/postings")
        else:
            self._store(self.postings().drop("bucket", "segment"), f"{self.root}/{name}/postings")
        last.filter("chunks > 0").drop("segment").write.parquet(f"{self.root}/{name}/files")
        return self._with([name])

    def _with(self, segments: list[str]) -> ChunkIndex:
        return ChunkIndex(self.spark, self.root, segments, self.buckets)

    def remove(self) -> None:
        """Deletes the folder."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    # -- reading

    def _each(self, table: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{s}/{table}").withColumn("segment", F.lit(no)) for no, s in enumerate(self.segments)]
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def files(self) -> DataFrame:
        """The last word on every file (file_id, chunks, total0, total1, segment)."""
        rows = self._each("files", FILES)
        if len(self.segments) < 2:
            return rows
        last = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("segment")))
        return rows.withColumn("n", last).filter("n = 1").drop("n")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """Living postings, of some terms (whose buckets alone are read) or all."""
        rows = self._each("postings", POSTINGS)
        if terms is not None:
            asked = self.spark.createDataFrame([(t,) for t in terms], "t string").select("t", bucket_of("t", self.buckets).alias("b")).collect()
            rows = rows.filter(F.col("bucket").isin(sorted({r["b"] for r in asked})) & F.col("term").isin(terms))
        if len(self.segments) < 2:
            return rows
        return rows.join(self.files().select("file_id", "segment"), ["file_id", "segment"], "left_semi").select("term", "field", "file_id", "chunk_index", "length", "bucket", "segment")

    def hits(self, terms: list[str]) -> tuple[DataFrame, DataFrame]:
        """What scoring needs: the chunks that hold a term (id, file_id, for each field the terms h and its length l), and one row of statistics: n, and for each field
        the average length and the chunks that hold each term."""
        n = range(len(FIELDS))
        living = self.postings(terms)
        of = lambda i: F.col("field") == i
        held = living.groupBy("file_id", "chunk_index").agg(
            *[F.collect_set(F.when(of(i), F.col("term"))).alias(f"h{i}") for i in n], *[F.coalesce(F.max(F.when(of(i), F.col("length"))), F.lit(0)).alias(f"l{i}") for i in n]
        )
        rows = held.select(F.concat_ws("#", "file_id", "chunk_index").alias("id"), "file_id", *[f"h{i}" for i in n], *[f"l{i}" for i in n])
        number = [(i, t) for i in n for t in terms]
        counts = living.agg(*[F.count_if(of(i) & (F.col("term") == t)).alias(f"n{k}") for k, (i, t) in enumerate(number)])
        sizes = self.files().agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n"), *[F.try_divide(F.sum(f"total{i}"), F.sum("chunks")).alias(f"avg{i}") for i in n])
        return rows, sizes.crossJoin(counts)  # one row each
