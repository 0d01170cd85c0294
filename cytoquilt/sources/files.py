"""Small files through Spark's file systems, and scratch folders that all executors see."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


class Files:
    """Read, write and list small files at any path that Spark can read."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self._path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file; fails if there is one already, so that of two writers one wins."""
        out = self.fs.create(self._at(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def list(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(name))) if self.exists(name) else []

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._at(name), True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a temporary one on a single machine only (tests)."""
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not shared and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set: executors and driver have no shared folder")
    base = shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="cytoquilt-")
    return f"{base}/{name}-{os.urandom(6).hex()}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative step through the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoint"))
    return df.checkpoint()
