"""How much Spark hands to Python at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch.  Spark's own 64 MB are held twice by each worker while the next batch is read, and once more by the executor.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` and one row at most from now on in this session; a lower bound stays.

    Spark takes the bound when a query runs, so it holds for tables that are returned unread as well.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_SETTING))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_SETTING, str(BATCH_BYTES))
