"""Notes and snapshots in files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.functions.text import normal_path
from memlattice.sources.snapshots import read_snapshot


def scan_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(relative_path, file_timestamp in whole seconds) of all .md and .txt files below a folder; contents are not read."""
    rows = _files(spark, folder).select("path", F.col("modificationTime").cast("timestamp").cast("long").alias("file_timestamp"))
    return rows.select(_relative(folder).alias("relative_path"), "file_timestamp")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """As ``scan_notes``, with content: UTF-8, bad bytes dropped, line ends unified."""
    rows = _files(spark, folder)
    text = F.replace(F.expr("try_validate_utf8(cast(content as string))"), F.lit("\r\n"), F.lit("\n"))
    loose = F.regexp_replace(F.expr("make_valid_utf8(cast(content as string))"), "�", "")
    content = F.replace(F.coalesce(text, F.replace(loose, F.lit("\r\n"), F.lit("\n"))), F.lit("\r"), F.lit("\n"))
    return rows.select(_relative(folder).alias("relative_path"), F.col("modificationTime").cast("timestamp").cast("long").alias("file_timestamp"), content.alias("content"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").load(folder)


def _relative(folder: str):
    base = folder.split("://")[-1].rstrip("/")
    return normal_path(F.expr("path").substr(F.instr("path", base) + len(base), F.lit(1 << 30)))


def list_backups(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of the JSON backups in a folder, newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return files.select("path", "length", F.col("modificationTime").cast("timestamp").cast("long").alias("modified")).orderBy(F.desc("modified"), F.desc("path"))


def preview_backup(spark: SparkSession, path: str) -> DataFrame:
    return read_snapshot(spark, path).agg(F.count("*").alias("records"), F.count_if("is_active").alias("active"))


def prune_backups(spark: SparkSession, folder: str, keep: int = 3) -> list[str]:
    """Deletes all but the newest backups; returns what went."""
    old = [r["path"] for r in list_backups(spark, folder).offset(keep).collect()]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in old:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, False)
    return old


def prune_backup_folders(spark: SparkSession, folder: str, keep: int = 3) -> list[str]:
    """Deletes all but the newest backups that are folders named by their day (eight digits); returns what went."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted((s.getPath() for s in fs.listStatus(p) if s.isDirectory() and re.fullmatch("[0-9]{8}", s.getPath().getName())), key=lambda x: x.getName(), reverse=True)
    for old in days[keep:]:
        fs.delete(old, True)
    return [x.getName() for x in days[keep:]]


def write_note(spark: SparkSession, folder: str, name: str, body: str) -> str:
    """Writes one note file through the file system that the folder is on."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    out = p.getFileSystem(conf).create(p, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()
    return p.toString()
