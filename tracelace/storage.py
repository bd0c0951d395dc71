"""Written tables and checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tracelace-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    Cuts the lineage and keeps a costly projection from being computed by each of its readers. The table
    outlives lost executors, as the input does. It stays until the folder is cleared; see ``scratch``.
    """
    return _write(df, f"{shared_dir(df.sparkSession)}/tracelace/{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, through Spark's own file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables of one computation: each by its name, removed singly or all at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/tracelace/scratch-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return _write(df, f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A ``Scratch`` whose tables go when the block ends; what the block gives must be written elsewhere before."""
    keep = Scratch(spark)
    try:
        yield keep
    finally:
        remove(spark, keep.folder)
