"""Session plumbing."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_path(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it.

    Enough in local mode and where nodes share the folder; elsewhere the package is
    installed on the nodes or passed with ``--py-files``, and the extra entry does nothing.
    """
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    return spark


def load(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables of a folder."""
    return share_path(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all nodes share; in local mode without one a folder is chosen."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
            folder = "file://" + tempfile.mkdtemp(prefix="memlattice-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read from there, for plans that need them more than once.

    Spark removes them when nothing uses them any more (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
