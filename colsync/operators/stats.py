"""Block-size and ratio studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsync.operators.codecs import POOL, measure

#: Block sizes of the column study, in KiB, and of the study of small blocks, in bytes.
COLUMN_SIZES = (1, 5, 10, 50, 100, 500, 1000)
SMALL_SIZES = tuple(range(100, 1000, 100))


def _ratios(name: str) -> tuple[Column, ...]:
    return F.count(name).alias("n"), F.avg(name).alias("mean"), F.var_samp(name).alias("variance"), F.min(name).alias("least"), F.max(name).alias("largest")


def ratio_stats(df: DataFrame, by: list[str], ratio: Column) -> DataFrame:
    """Number, mean, sample variance, least and largest ratio of each group; a single value has no variance."""
    return df.select(*by, ratio.alias("_r")).groupBy(*by).agg(*_ratios("_r"))


def block_study(columns: DataFrame, value: str, keys: list[str], sizes: tuple[int, ...], codecs: tuple[int, ...] = POOL) -> DataFrame:
    """Ratio (compressed over original) and speeds of each codec by block size.

    Speeds of compression and of decompression each go by their own time; a time
    too short for the clock gives none.
    """
    by = [*keys, "block_size", "codec"]
    measured = measure(columns, value, keys, codecs, sizes).withColumn("_r", F.col("cmpr_len") / F.col("ori_len"))
    speed = lambda time: F.sum("ori_len") / F.nullif(F.sum(time), F.lit(0.0))
    totals = (F.sum("ori_len").alias("ori_len"), F.sum("cmpr_len").alias("cmpr_len"), speed("seconds").alias("compress_bw"), speed("decode_seconds").alias("decompress_bw"))
    # one pass over the measurements: what is measured is measured once
    return measured.groupBy(*by).agg(*totals, *_ratios("_r"))


def phase_totals(timings: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Seconds of each phase by name, and how often it ran: ``timings`` has a row for each run."""
    return timings.groupBy(by).agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in columns])
