"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names.

A written table cuts the lineage, survives the loss of executors and gives the next step real column pruning and real
size statistics. The folder has to be visible to every executor, so a temporary folder is made only for a local master.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; made on the spot only when Spark runs in this one process."""
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark.sparkContext.getCheckpointDir()


def open_store(uri: str):
    """Arrow's file system and the path in it for a URI or a plain path, for tasks that read parts of files."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never used twice."""
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and go on from the written copy. ``codec`` is one of Parquet's, for copies of long texts."""
    path = scratch_path(df.sparkSession, label)
    (df.write if codec is None else df.write.option("compression", codec)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_table(df: DataFrame, label: str) -> DataFrame:
    """Write the side of a join that has one row per key.

    Its true size then decides whether it is broadcast. If it is not, both sides of the sort-merge join come straight
    from a shuffle, which is what adaptive execution needs in order to split a hot key of the other side.
    """
    return materialize(df, label)
