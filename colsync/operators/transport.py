"""Packages on the wire: headers, rate models, receiver metrics and a folder sink."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsync.functions.binary import little_endian, to_little_endian
from colsync.operators.blocks import packet_offsets
from colsync.operators.folds import fold_sorted

#: The fields of a package's header after its 2-byte tag, 8 bytes each, and the tag.
HEADER_FIELDS = ("ori_len", "cmpr_len", "start_ts", "total_events", "tran_start_ts", "net_bw", "cmpr_threads")
TAG, TAG_END, HEADER_BYTES = 1, 2, 58
#: Steps of the bandwidth ladder, and seconds for which a wandering rate holds.
STEPS, HOLD_S = 5, 3


def package_header(fields: dict[str, Column]) -> Column:
    """The 58 bytes in front of a package."""
    return F.concat(to_little_endian(F.lit(TAG), 2), *[to_little_endian(fields[n], 8) for n in HEADER_FIELDS])


def parse_header(data: str) -> dict[str, Column]:
    """The fields of a package's header; a wrong tag or a header cut short raises."""
    tag = F.when(little_endian(data, 1, 2) == TAG, F.lit(True)).otherwise(F.raise_error(F.lit("not a package")))
    return {n: F.when(tag, little_endian(data, 3 + 8 * i, 8).cast("long")) for i, n in enumerate(HEADER_FIELDS)}


def latency_seconds(start: Column, sent: Column, cmpr_len: Column, threads: Column, bandwidth: Column) -> Column:
    """From the cut of a block to its arrival, start and send in nanoseconds."""
    return (sent - start) / 1e9 + cmpr_len * threads / bandwidth


def throughput(size: Column, seconds: Column) -> Column:
    """Bytes a second of a send."""
    return size / F.greatest(seconds, F.lit(1e-9))


def throttle_seconds(size: Column, rate: Column, elapsed: Column, threads: Column, threshold: int) -> Column:
    """How long a rate-limited writer sleeps after a write; writes of up to ``threshold`` bytes don't wait."""
    return F.when(size > threshold, F.greatest(F.lit(0.0), (size / rate - elapsed) * threads)).otherwise(0.0)


def ladder_rate(number: Column, rate: int, balance: int) -> Column:
    """The rate of the ``number``-th write, from 0.

    Five whole steps go from ``rate - balance`` to ``rate + balance``.  The first
    write has the given rate; each one after it takes the next step, from the
    second on, and after the last begins with the first.
    """
    steps = [rate - balance + i * 2 * balance // (STEPS - 1) for i in range(STEPS)]
    return F.when(number == 0, F.lit(rate)).otherwise(F.element_at(F.array(*[F.lit(s) for s in steps]), (number % STEPS + 1).cast("int"))).cast("long")


def _unit(seed: int, number: Column) -> Column:
    """A number of 60 bits that looks random, the same for the same seed and number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string"))), 1, 15), 16, 10).cast("long")


def walk_rate(seconds: Column, rate: int, balance: int, seed: int = 1111) -> Column:
    """A rate that is drawn anew every three seconds from ``rate - balance`` up to but not ``rate + balance``; before that, and without a balance, the given one."""
    step = F.floor(seconds / HOLD_S)
    if not balance:
        return F.lit(rate).cast("long")
    return F.when(step < 1, F.lit(rate)).otherwise(_unit(seed, step) % (2 * balance) + rate - balance).cast("long")


def bytes_in_flight(df: DataFrame, by: list[str], order: list[str], sent: Column, acknowledged: Column) -> DataFrame:
    """``in_flight`` after each row: what was sent less what has arrived."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("in_flight", F.sum(sent - acknowledged).over(w))


def completed(df: DataFrame, by: list[str], order: list[str], total: Column) -> DataFrame:
    """``received`` so far and whether that is all, after each package; summed by ranges of the order, so one long stream is no single task."""
    placed = packet_offsets(df.withColumn("_total", total), F.col("ori_len"), by, order)
    return placed.withColumn("received", F.col("offset") + F.col("packet_len")).withColumn("done", F.col("received") >= F.col("_total")).drop("_total", "offset", "packet_len")


class TokenBucket:
    """A bucket that is filled anew every ``period`` seconds; what is left of the fill before is not kept.

    A fill has ``rate * period`` bytes.  Every ``balance_s`` seconds of fills
    the amount is drawn anew from that less or more ``balance * period``.
    Writes of up to ``threshold`` bytes take nothing.
    """

    def __init__(self, rate: float, period: float, balance: float = 0.0, balance_s: float = 1.0, threshold: float = 0.0, seed: int = 1111):
        self.fill, self.spread, self.period, self.threshold, self.seed = rate * period, balance * period, period, threshold, seed
        self.every = max(1, int(balance_s / period))
        self.left, self.fills, self.next = 0.0, 0, None

    def _amount(self) -> float:
        """Bytes of the fill that comes now."""
        epoch = self.fills // self.every
        if not epoch or not self.spread:
            return self.fill
        unit = int(hashlib.md5(f"{self.seed}:{epoch}".encode()).hexdigest()[:15], 16) / float(1 << 60)
        return self.fill + (2 * unit - 1) * self.spread

    def write(self, size: float, now: float) -> float:
        """When a write that comes now may go out."""
        if self.next is None:
            self.next = now
        if size <= self.threshold:
            return now
        taken = min(self.left, size)
        self.left, size = self.left - taken, size - taken
        while size > 0:
            now = max(now, self.next)
            # fills that go whole, but for the last one and those before the amount changes
            many = int(max(0, min(size // self.fill - 1, self.every - 1 - self.fills % self.every if self.spread else size // self.fill - 1)))
            if many and self._amount() == self.fill:
                now, size, self.fills = now + many * self.period, size - many * self.fill, self.fills + many
            self.next, self.fills = now + self.period, self.fills + 1
            self.left = self._amount()
            taken = max(0.0, min(self.left, size))
            self.left, size = self.left - taken, size - taken
        return now


def token_bucket(df: DataFrame, by: list[str], order: list[str], size: str, at: str, rate: float, period: float, **options) -> DataFrame:
    """Waits of the writes of each key, one after the other, at a ``TokenBucket``: ``*by, n_writes, waited_s, tokens``.

    Times of ``at`` are in seconds; a write begins when it comes and the one before it is out.
    A key's writes stream, however many.
    """
    class Writer:
        bucket, free, waited, n = None, float("-inf"), 0.0, 0

    def start() -> Writer:
        writer = Writer()
        writer.bucket = TokenBucket(rate, period, **options)
        return writer

    def step(writer: Writer, rows: pd.DataFrame) -> None:
        for n, moment in zip(rows[size].astype(float), rows[at].astype(float), strict=True):
            now = max(writer.free, moment)
            writer.free = writer.bucket.write(n, now)
            writer.waited += writer.free - now
        writer.n += len(rows)

    return fold_sorted(df.select(*dict.fromkeys([*by, *order, size, at])), by, order, start, step, lambda w: (w.n, w.waited, w.bucket.left), "n_writes long, waited_s double, tokens double")


def bandwidth_feedback(df: DataFrame, by: list[str], order: list[str], size: Column, seconds: Column, at: Column, start: float, least: int = 0, idle: float = 5.0) -> DataFrame:
    """``bandwidth`` that a planner knows after each send: that of the last send of ``least`` bytes or more.

    Before the first such send, and after a pause of more than ``idle`` seconds, it is ``start``.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_at", at).withColumn("_m", F.when(size >= least, throughput(size, seconds)))
    paused = F.coalesce((F.col("_at") - F.lag("_at").over(w)) > idle, F.lit(False)).cast("int")
    spans = rows.withColumn("_p", paused).withColumn("_span", F.sum("_p").over(so_far))
    within = Window.partitionBy(*by, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return spans.withColumn("bandwidth", F.coalesce(F.last("_m", ignorenulls=True).over(within), F.lit(float(start)))).drop("_at", "_m", "_p", "_span")


def received_metrics(packages: DataFrame) -> DataFrame:
    """What the receiver reports for each package: latency, gain, throughput."""
    latency = latency_seconds(F.col("start_ts"), F.col("tran_start_ts"), F.col("cmpr_len"), F.col("cmpr_threads"), F.col("net_bw"))
    return packages.withColumn("latency_s", latency).withColumn("gain", F.col("ori_len") / F.greatest("cmpr_len", F.lit(1))).withColumn("transmit_s", F.col("cmpr_len") / F.col("net_bw"))


def write_packages(packages: DataFrame, path: str, batch: int | None = None) -> None:
    """Write packages to a folder; a batch that is written again replaces itself."""
    target = path if batch is None else f"{path}/batch={batch}"
    packages.write.mode("overwrite").parquet(target)
