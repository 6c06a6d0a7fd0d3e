"""Exact deduplication by skew-safe combining (DataFrame functions only).

Stages, each of which compares the full normalised content and not just its digest:

1. local: Spark's map-side half of the first ``groupBy`` folds the rows of one input
   partition by (digest, salt, content) before anything is sent;
2. salted: the rest of that ``groupBy`` merges the groups of one salt, so the copies of
   one text meet in ``salts`` places instead of one;
3. global: the at most ``salts`` winners of a text are combined.

Documents are then labelled through their digest.  The contents of each digest are counted, those of
single rows too; while every digest has one content (SHA-256: always so far) labelling by
digest equals labelling by content and the texts need no third shuffle.  Were two
contents ever to share a digest, the labelling join carries the content as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.llm.common import WS_CLASS, Scratch, text_or_empty

SALTS = 16


def normalised(text):
    return F.regexp_replace(text, WS_CLASS, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per content: digest, content, keep_id, group_size."""
    t = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.char_length(t).alias("cp"),
        normalised(t).alias("content"),
    ).select(
        F.unhex(F.sha2("content", 256)).alias("digest"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"),
        "content",
        # max of this struct: most code points, then smallest id; a null id loses to any other
        F.struct("cp", F.negate("id").alias("neg")).alias("rank"),
    )
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    merged = salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))
    return merged.select("digest", "content", F.negate(F.col("rank.neg")).alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every row of ``docs``.

    Texts are equal if they are the same after ASCII white space is deleted.  A null text
    counts as empty; empty texts are copies of each other.  Of a group the row with the
    most code points stays, then the one with the smallest id; a row without id stays only
    if its whole group has none (keep_id is then null and kept false).  Rows that repeat an id
    each count in group_size and share one ``kept``.  Columns of ``docs`` that have the names added
    here are replaced; others pass through.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    groups = exact_groups(docs, id_col, text_col, salts)
    narrow = scratch.save(groups.select("digest", "keep_id", "group_size"))
    shared_digest = not narrow.groupBy("digest").count().filter("count > 1").isEmpty()
    # only groups of two or more have anything to tell their rows
    repeated, narrow = groups.filter("group_size > 1"), narrow.filter("group_size > 1")
    content = normalised(text_or_empty(text_col))
    digest = F.sha2(content, 256)
    rows = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    d = rows.withColumn("text_sha256", digest)
    salted = d.withColumn("__digest", F.unhex("text_sha256")).withColumn(
        "__salt", F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(salts)).cast("int")
    )
    fan = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt")
    if shared_digest:
        g = repeated.select(F.col("digest").alias("__digest"), F.col("content").alias("__content"), "keep_id", "group_size", fan)
        joined = salted.withColumn("__content", content).join(g, ["__digest", "__salt", "__content"], "left")
    else:
        g = narrow.select(F.col("digest").alias("__digest"), "keep_id", "group_size", fan)
        joined = salted.join(g, ["__digest", "__salt"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col(id_col).cast("long")).otherwise(F.col("keep_id"))
    return joined.select(
        *[F.col(c) for c in rows.columns],
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col(id_col).cast("long") == keep, F.lit(False)).alias("kept"),
        "text_sha256",
    )
