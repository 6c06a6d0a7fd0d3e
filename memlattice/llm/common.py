"""Shared plumbing: scratch tables in the cluster's shared folder, table reading, word pattern."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.session import load, share_path

#: ASCII white space, as a Java/RE2 character class body and as the six characters.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = load(spark, sf_dir, name)
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode (tests) one is chosen where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        found = "file://" + tempfile.mkdtemp(prefix="memlattice-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[Scratch] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Removes, at the end or when it fails, the tables that operators called inside have written to the shared folder."""
    mark = len(_made)
    try:
        yield
    finally:
        for s in _made[mark:]:
            s.remove()
        del _made[mark:]


class Scratch:
    """Parquet tables in the shared folder.

    Writing one cuts the lineage in storage that every executor reads, so a lost
    executor costs only the tasks it was running.  ``drop`` removes tables that a
    later step has superseded.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = share_path(spark)
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        _made.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self.remove(path)

    def remove(self, path: str | None = None) -> None:
        """Deletes one table, or all of them."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path or self.base)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


_state: dict = {}


def worker_state(key, make):
    """What ``make`` builds for ``key``.  A worker process keeps one such value, so those of operators that follow each other do not add up."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_pattern_count(name: str):
    """How many words of WORD a text has."""
    return F.size(F.regexp_extract_all(F.col(name), F.lit(f"({WORD})"), F.lit(1))).cast("long")
