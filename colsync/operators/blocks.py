"""Cutting packet streams into blocks.

Fixed cuts are arithmetic on offsets.  The greedy cut at packet boundaries
depends on each block before it, so it goes over an index of short rows,
offset, length and class, in three steps: each stretch of a file finds, in a
task of its own, how it would be cut for every place at which its first block
may begin; the stretches of a file are put together from these short tables;
then each is cut from where the one before has left off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from colsync.operators.folds import edges


def _range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most the value, by halving; 0 for null."""

    def halve(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(value >= F.lit(bounds[middle]), halve(middle + 1, hi)).otherwise(halve(lo, middle))

    return halve(0, len(bounds))


def parted(rows: DataFrame, order: list[str], ranges: int) -> DataFrame:
    """The rows with ``_part``, their range by approximate quantiles of the first column of the order; 0 for all if it is no number, date or time."""
    kind, bounds = rows.schema[order[0]].dataType, []
    if isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        found = rows.agg(F.percentile_approx(order[0], [i / ranges for i in range(1, ranges)], 1000)).first()[0]
        bounds = sorted(set(found or []))
    return rows.withColumn("_part", _range_of(F.col(order[0]), bounds))


#: The name by which tests know it.
_parted = parted


def packet_offsets(df: DataFrame, length: Column, by: list[str], order: list[str], ranges: int = 64) -> DataFrame:
    """``offset`` of each packet: the lengths before it in its file.

    Quantiles of the first column of the order (a number, date or time; files of
    any other order stay whole) cut each file into ``ranges`` parts, so a hot file
    is no single task: parts are summed, and their sums lead the rows of the parts
    after them.  The quantiles are approximate and only balance the work.
    """
    in_parts = parted(df.withColumn("packet_len", length.cast("long")), order, ranges).withColumn("_row", F.lit(True))
    before = lambda w: F.coalesce(F.sum("packet_len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    sums = in_parts.groupBy(*by, "_part").agg(F.sum("packet_len").alias("packet_len"))
    leads = sums.select(*by, "_part", before(Window.partitionBy(*by).orderBy("_part")).alias("packet_len"), F.lit(False).alias("_row"))
    placed = in_parts.unionByName(leads, allowMissingColumns=True)
    return placed.withColumn("offset", before(Window.partitionBy(*by, "_part").orderBy("_row", *order))).where("_row").drop("_part", "_row")


def fixed_blocks(index: DataFrame, size: int, by: list[str]) -> DataFrame:
    """Blocks of ``size`` bytes, whatever the packets: ``*by, block_no, n_packets, ori_len``; a packet counts in each block that it touches."""
    last = F.col("offset") + F.col("packet_len") - 1
    touched = index.where("packet_len > 0").select(*by, "offset", "packet_len", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor(last / size))).alias("block_no"))
    low, high = F.greatest("offset", F.col("block_no") * size), F.least(F.col("offset") + F.col("packet_len"), (F.col("block_no") + 1) * size)
    return touched.groupBy(*by, "block_no").agg(F.count("*").alias("n_packets"), F.sum(high - low).cast("long").alias("ori_len"))


class Cutter:
    """Blocks of one file, from batches of its packets in order: what it keeps is where the open block began.

    A block takes packets of one kind while they begin at most ``size`` bytes
    after its start, so it goes over ``size`` by one packet at most.
    """

    def __init__(self, size: int):
        self.size, self.number, self.start, self.kind = size, -1, 0, None

    def cut(self, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The block of each packet of the next batch."""
        n = len(offsets)
        change = np.append(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, n)
        out, at = np.empty(n, np.int64), 0
        while at < n:
            if self.number < 0 or kinds[at] != self.kind or offsets[at] > self.start + self.size:
                self.number, self.start, self.kind = self.number + 1, int(offsets[at]), kinds[at]
            to = min(int(np.searchsorted(offsets, self.start + self.size, side="right")), int(change[np.searchsorted(change, at, side="right")]))
            out[at:to] = self.number
            at = to
        return out


def _outcomes(offsets: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """How a stretch is cut for each place at which its first block may begin: ``at, n_blocks, start, kind``.

    A block that is open when the stretch begins ends at the first packet beyond
    ``its start + size``, at the first change of kind at the latest; it began no
    later than the stretch, so only packets up to ``size`` after the first one
    count.  The row that holds is the first with ``at`` beyond ``start + size``,
    or the first of all if the open block is of another kind; without one the
    block stays open.  Places that are cut alike share a row.
    """
    n = len(offsets)
    change = np.append(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, n)
    after = np.append(np.minimum(np.searchsorted(offsets, offsets + size, side="right"), change[np.searchsorted(change, np.arange(n), side="right")]), n)
    count, last = np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
    while (after < n).any():  # twice the steps each time
        count, last = count + count[after], np.where(after < n, last[after], last)
        after = after[after]
    far = int(np.searchsorted(offsets, offsets[0] + size, side="right"))
    first = np.arange(min(far, int(change[0]), n - 1) + 1)
    first = first[(first == 0) | (offsets[first] > offsets[first - 1]) | (first == change[0])]
    at = np.where((first == change[0]) & (first > 0), np.iinfo(np.int64).max, offsets[first])
    ends = np.append(np.flatnonzero((np.diff(count[first]) != 0) | (np.diff(last[first]) != 0)), len(first) - 1)
    first, at = first[ends], at[ends]
    return at, count[first], offsets[last[first]], kinds[last[first]]


def bound_blocks(index: DataFrame, size: int, stretch: int | None = None) -> DataFrame:
    """The block of each packet: ``file, packet_no, block_no, offset, packet_len, class``; ``index`` has all but the block.

    A task holds the index of ``stretch`` bytes of a file (16 blocks, at least 16
    MiB), however long the file is; what follows one after the other for a file is
    a row for each way to cut a stretch.
    """
    stretch = stretch or max(16 << 20, 16 * size)
    rows = index.select("file", "packet_no", "offset", "packet_len", "class", F.coalesce(F.col("class").cast("int"), F.lit(-1)).alias("kind"), F.expr(f"offset div {stretch}").alias("part"))
    parts = rows.groupBy("file", "part")

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("packet_no")
        kinds = pdf["kind"].to_numpy()
        at, count, start, kind = _outcomes(pdf["offset"].to_numpy(), kinds, size)
        return pd.DataFrame({"file": pdf["file"].iloc[0], "part": pdf["part"].iloc[0], "first": kinds[0], "at": at, "n_blocks": count, "start": start, "kind": kind})

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, file, state = None, None, None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            cut = edges(held, ["file", "part"])
            for a, b in zip(cut, cut[1:-1], strict=False):  # the last part may go on in the next batch
                row, file, state = _enter(held.iloc[a:b], file, state)
                yield row
            held = held.iloc[cut[-2] :]
        if held is not None and len(held):
            yield _enter(held, file, state)[0]

    def _enter(part: pd.DataFrame, file, state):
        """The state in which a part begins, and the one after it: number of the open block, its start and kind."""
        name = part["file"].iloc[0]
        if state is None or name != file:
            state = (-1, 0, 0)
        row = pd.DataFrame({"file": [name], "part": part["part"].iloc[:1].to_numpy(), "number": [state[0]], "start": [state[1]], "kind": [state[2]]})
        broken = state[0] < 0 or state[2] != part["first"].iloc[0]
        i = 0 if broken else int(np.searchsorted(part["at"].to_numpy(), state[1] + size, side="right"))
        if i < len(part):
            way = part.iloc[i]
            state = (state[0] + int(way["n_blocks"]), int(way["start"]), int(way["kind"]))
        return row, name, state

    def fold(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("packet_no")
        cutter = Cutter(size)
        cutter.number, cutter.start, cutter.kind = (int(begin[c].iloc[0]) for c in ("number", "start", "kind"))
        return pdf.assign(block_no=cutter.cut(pdf["offset"].to_numpy(), pdf["kind"].to_numpy()))[["file", "packet_no", "block_no", "offset", "packet_len", "class"]]

    found = parts.applyInPandas(ways, "file string, part long, first int, at long, n_blocks long, start long, kind int")
    begins = found.repartition("file").sortWithinPartitions("file", "part", "at").mapInPandas(chain, "file string, part long, number long, start long, kind int")
    return parts.cogroup(begins.groupBy("file", "part")).applyInPandas(fold, "file string, packet_no long, block_no long, offset long, packet_len long, class boolean")


def block_summary(cut_packets: DataFrame, start: int = 0, interval_ms: int = 0) -> DataFrame:
    """Blocks: ``file, block_no, first_packet, n_events, ori_len, class, cut_ms``; block ``k`` is cut ``k`` intervals after the start."""
    rows = cut_packets.groupBy("file", "block_no").agg(F.min("packet_no").alias("first_packet"), F.count("*").alias("n_events"), F.sum("packet_len").cast("long").alias("ori_len"), F.max("class").alias("class"))
    return rows.withColumn("cut_ms", F.lit(start) + F.col("block_no") * interval_ms)


def class_islands(df: DataFrame, kind: Column, by: list[str], order: list[str], ranges: int = 64) -> DataFrame:
    """Stretches of neighbours of one class: ``*by, island, class, n_packets``.

    Runs are found in ranges of each file, as in ``packet_offsets``, so a hot file is
    no single task.  A range says its first and last class and its number of runs; from
    these short rows follows whether its first run goes on with the last one of the range
    before, and so the number that it has.
    """
    in_parts = parted(df.select(*dict.fromkeys([*by, *order]), kind.alias("class")), order, ranges)
    w = Window.partitionBy(*by, "_part").orderBy(*order)
    step = F.when((F.row_number().over(w) == 1) | F.lag("class").over(w).eqNullSafe(F.col("class")), 0).otherwise(1)
    place = F.struct(*order)
    runs = in_parts.withColumn("_step", step).withColumn("_run", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy(*by, "_part", "_run").agg(F.first("class").alias("class"), F.count("*").alias("n_packets"), F.min(place).alias("_at"))
    ends = runs.groupBy(*by, "_part").agg(F.min_by("class", "_at").alias("_first"), F.max_by("class", "_at").alias("_last"), F.max("_run").alias("_more"))
    line = Window.partitionBy(*by).orderBy("_part")
    # 0 where the first run of a range is the last one of the range before
    opens = F.when((F.row_number().over(line) > 1) & F.lag("_last").over(line).eqNullSafe(F.col("_first")), 0).otherwise(1)
    bases = ends.withColumn("_opens", opens).withColumn("_base", F.sum(F.col("_opens") + F.col("_more")).over(line) - F.col("_more")).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("_part").alias("_in"), "_base")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    placed = runs.join(bases, same & (F.col("_part") == F.col("_in"))).withColumn("island", F.col("_base") + F.col("_run"))
    return placed.groupBy(*by, "island").agg(F.first("class").alias("class"), F.sum("n_packets").alias("n_packets"))


def fixed_chunks(data: bytes, size: int) -> Iterator[bytes]:
    """A byte string in pieces of ``size``; the last one is what is left."""
    for at in range(0, len(data), size):
        yield data[at : at + size]
