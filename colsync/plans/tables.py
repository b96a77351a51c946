"""Tables of a run, written once in the folder that the cluster shares, and used again by whoever runs it again.

``spark.checkpoint.dir`` names that folder.  Only where it is unset and the
session runs on this machine alone, as in tests, a temporary folder takes its
place and goes at the end of the session.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new subfolder of the shared folder."""
    root = spark.conf.get(_SETTING, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="colsync-")
        atexit.register(shutil.rmtree, root, True)
    return f"{root.rstrip('/')}/colsync/{name}-{uuid.uuid4().hex}"


class Tables:
    """The tables of one run in its folder.

    A table is made the first time it is asked for and read from then on, also
    by a later run over the same folder: what depends on a clock, such as a plan
    made from timings, stays as it was first written.  A table counts as written when Spark's
    ``_SUCCESS`` is there; what a run that has died left of one is replaced.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or new_folder(spark, "run")).rstrip("/")

    def _path(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def has(self, name: str) -> bool:
        fs, where = self._path(f"{name}/_SUCCESS")
        return fs.exists(where)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of this name, made if it isn't there."""
        if not self.has(name):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        fs, where = self._path(name)
        fs.delete(where, True)

    def clear(self) -> None:
        """Delete the folder, when nothing reads it any more."""
        fs, where = self._path("")
        fs.delete(where, True)
