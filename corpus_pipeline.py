"""From raw documents to token ids: five operators of memlattice.llm, one after the other.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; its result
is written as Parquet in the cluster's shared folder and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm.bpe import bpe_round_trip
from memlattice.llm.common import Scratch, table, temporary
from memlattice.llm.exact_dedup import exact_dedup
from memlattice.llm.language_id import UNDETERMINED, identify_language
from memlattice.llm.mixing import mix
from memlattice.llm.near_dedup import near_dedup

#: Jaccard from which on documents are near copies here; op1 links from 0.85 on.
NEAR = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without letters are rejected.  Repeated rows are told alike, ties go to the
    language first by code point."""
    return identify_language(docs).filter(F.col("lang_pred") != UNDETERMINED).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of exact copies.  Rows without id stay unless they copy another row."""
    found = exact_dedup(docs)
    stays = found.filter(F.col("kept") | (F.col("doc_id").isNull() & F.col("keep_id").isNull()))
    if not docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        stays = stays.dropDuplicates(["text_sha256"])  # rows that the id does not tell apart
    return stays.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.  Rows that the id does not tell apart are told apart by a number; texts without words stay."""
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        rows = docs.withColumn("__row", F.col("doc_id"))
    else:
        rows = Scratch(spark, "rows").save(docs.withColumn("__row", F.monotonically_increasing_id()))
    copies = near_dedup(rows, "__row", similarity=NEAR).filter("not kept").select("__row")
    return rows.join(copies, "__row", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, a row for each copy that it takes.  Texts without words are never taken; repeated rows are documents of their own."""
    return mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the hash of the bytes that they decode to.  A null text has no ids; repeated rows are coded each."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_round_trip(docs, path, public_tokenizers.PATTERN, keep=("lang", "source"), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", source_mix),
    ("bpe", token_ids),
]

#: SQL cannot state the first, third and fifth stage; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage has written for itself, and its input, go when its result is there."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        with temporary():
            before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
