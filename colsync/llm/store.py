"""Tables between the steps of an operator, in the folder that the cluster shares.

``spark.checkpoint.dir`` names that folder.  Only where it is unset and the
session runs on this machine alone, as in tests, a temporary folder takes its
place; on a cluster it has to be set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Spark deletes the shuffle files of an execution when it ends; a stage that needs them again makes them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colsync-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


class Scratch:
    """A fresh subfolder for the tables of one run; written tables cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/colsync/{name}-{uuid.uuid4().hex}"
        self._made: list[tuple[str, str]] = []

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet and return the table read back; shuffle files of the step go once it is written."""
        path = f"{self.path}/{len(self._made) + 1:04d}-{name}"
        self._made.append((name, path))
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, which later steps don't read."""
        for name, path in self._made:
            if name in names:
                remove(self.spark, path)

    def clear(self) -> None:
        """Delete all tables, when nothing reads them any more."""
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
