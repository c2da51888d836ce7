"""Stored intermediate tables.

Lineage is cut by writing a table to the folder the cluster names in
``spark.checkpoint.dir``: a shared folder, so a lost executor costs a re-read
and no recomputation, and the re-read prunes columns and knows its size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Tables below one folder of their own; ``drop`` removes it when no result needs it."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/readalike-{uuid.uuid4().hex}"

    def folder(self, name: str) -> str:
        """A new place below the root, for files that aren't Spark tables."""
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Write once, return the stored table."""
        path = f"{self.root}/{name or uuid.uuid4().hex}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only in local mode, where every task runs on
    this machine, a temporary folder takes its place."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="readalike-")
    return _local_folders[context.applicationId]
