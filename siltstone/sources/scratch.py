"""The folder that driver and executors share, and the tables of one run in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or else the session's checkpoint folder. Where neither is set a session in one process gets
    a temporary folder; on a cluster that is an error, as executors would not see the driver's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and held.isDefined():
        root = held.get()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """One run's folder below the shared one.

    Tables written here cut the lineage: a lost executor costs the tasks that read the table, not the plan that made it.
    The folder goes when the driver's JVM ends; a step that is through with a table can ``drop`` it before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        top = self._path(self.root)
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(top)
        fs.deleteOnExit(top)

    def _path(self, uri: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(uri)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Write df as a table of this run and return a DataFrame that reads it."""
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name)).select(*like.columns)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path = self._path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
