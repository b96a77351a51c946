"""Column-aware codecs: run lengths, deltas, deltas of deltas, varints.

Each comes in two forms.  The relational form works on a DataFrame of values
with a partition and an order, and gives runs, differences or exact encoded
sizes without building bytes.  The byte form packs the values of one chunk with
numpy; it is used inside Arrow functions, on one chunk at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsync.functions.binary import dod_bits, varint_size, wrapped

# -- relational form ----------------------------------------------------------


def _window(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def rle_runs(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Runs of equal neighbours: ``*by, run_no, run_value, run_length``; null equals null."""
    w = _window(by, order)
    first = F.row_number().over(w) == 1
    starts = (first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("long")
    marked = df.select(*by, *order, value, starts.alias("_s"))
    numbered = marked.withColumn("run_no", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, "run_no").agg(F.first(value).alias("run_value"), F.count("*").alias("run_length"))


def rle_size(runs: DataFrame, width: int, by: list[str]) -> DataFrame:
    """Encoded bytes of each partition: a count, then a value and a length for each run."""
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), F.sum("run_length").alias("n_values"), (F.count("*") * (width + 4) + 4).alias("encoded_bytes"))


def rle_expand(runs: DataFrame, by: list[str]) -> DataFrame:
    """The values of runs in order: ``*by, position, value``."""
    before = Window.partitionBy(*by).orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_lo", F.coalesce(F.sum("run_length").over(before), F.lit(0)))
    return placed.select(*by, F.col("run_value").alias("value"), F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("run_length"))).alias("_i", "_n"), "_lo").select(*by, (F.col("_lo") + F.col("_i")).alias("position"), "value")


def delta_values(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Differences to the value before, modulo 2**32; the first is the value itself."""
    w = _window(by, order)
    d = F.col(value) - F.lag(value).over(w)
    return df.withColumn("delta", F.when(d.isNull(), wrapped(F.col(value))).otherwise(wrapped(d)))


def delta_undo(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Values from the differences: a running sum modulo 2**32."""
    w = _window(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("value", wrapped(F.sum("delta").over(w)))


def delta_size(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Encoded bytes: four for the first value, then a varint of twice each wrapped difference."""
    w = _window(by, order)
    d = wrapped(F.col(value) - F.lag(value).over(w))
    costs = df.select(*by, F.when(d.isNull(), 4).otherwise(varint_size(d * 2)).alias("_b"))
    return costs.groupBy(*by).agg(F.count("*").alias("n_values"), F.sum("_b").cast("long").alias("encoded_bytes"))


def dod_values(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """``delta`` and ``dod``, the difference of differences; null where there is none yet."""
    w = _window(by, order)
    rows = df.withColumn("delta", F.col(value) - F.lag(value).over(w))
    return rows.withColumn("dod", F.col("delta") - F.lag("delta").over(w))


def dod_size(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Encoded bits and bytes: the first two values take 32 bits each; a byte is opened ahead."""
    rows = dod_values(df, value, by, order)
    n, bits = F.count("*"), F.coalesce(F.sum(F.when(F.col("dod").isNotNull(), dod_bits("dod"))), F.lit(0))
    return rows.groupBy(*by).agg(n.alias("n_values"), (bits + 32 * F.least(n, F.lit(2))).cast("long").alias("bits")).withColumn("encoded_bytes", F.floor(F.col("bits") / 8) + 1)


def varint_sizes(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Bytes of the values as varints."""
    return df.groupBy(*by).agg(F.count(value).alias("n_values"), F.sum(varint_size(value)).cast("long").alias("encoded_bytes"))


def percent_split(length: Column, percents: list[int]) -> list[tuple[Column, Column]]:
    """Byte ranges of a column that is split by percentages; the last part takes what is left."""
    out, at, total = [], F.lit(0).cast("long"), 0
    for i, p in enumerate(percents):
        total += p
        to = length if i == len(percents) - 1 else F.floor(length * total / 100)
        out.append((at, to))
        at = to
    return out


# -- byte form ----------------------------------------------------------------


def rle_encode(values: np.ndarray) -> bytes:
    """Runs of the rows of a ``(n, width)`` byte array: count, run values, run lengths (all little-endian u32)."""
    n = len(values)
    if not n:
        return np.uint32(0).tobytes()
    first = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]).any(axis=1))))
    lengths = np.diff(np.append(first, n)).astype("<u4")
    return np.uint32(len(first)).tobytes() + values[first].tobytes() + lengths.tobytes()


def rle_decode(data: bytes, width: int) -> np.ndarray:
    """The rows again."""
    runs = int(np.frombuffer(data, "<u4", 1)[0])
    values = np.frombuffer(data, np.uint8, runs * width, 4).reshape(runs, width)
    return np.repeat(values, np.frombuffer(data, "<u4", runs, 4 + runs * width), axis=0)


def varint_encode(values: np.ndarray) -> bytes:
    """Base-128 varints, least significant group first."""
    left, parts, alive = values.astype(np.uint64), [], np.ones(len(values), bool)
    while alive.any():
        more = alive & (left >= 128)
        parts.append((np.where(more, (left & np.uint64(127)) | np.uint64(128), left & np.uint64(127)).astype(np.uint8), alive))
        left, alive = left >> np.uint64(7), more
    if not parts:
        return b""
    bytes_, used = np.stack([p for p, _ in parts], axis=1), np.stack([u for _, u in parts], axis=1)
    return bytes_[used].tobytes()


def varint_decode(data: bytes) -> np.ndarray:
    """All varints of the bytes."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.uint64)
    raw = raw[: last[-1] + 1]
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def delta_encode(values: np.ndarray) -> bytes:
    """u32 values: the first raw, then varints of twice the wrapped differences."""
    v = values.astype(np.uint32)
    if not len(v):
        return b""
    return v[:1].astype("<u4").tobytes() + varint_encode(np.diff(v).astype(np.uint64) * np.uint64(2))


def delta_decode(data: bytes) -> np.ndarray:
    """The u32 values again."""
    if not data:
        return np.zeros(0, np.uint32)
    steps = np.concatenate((np.frombuffer(data, "<u4", 1), (varint_decode(data[4:]) >> np.uint64(1)).astype(np.uint32)))
    return np.cumsum(steps, dtype=np.uint32)


#: Prefix bits and their number, then the bits of the value, for each step of the cost table.
_PREFIX = ((0b0, 1, 0), (0b10, 2, 7), (0b110, 3, 9), (0b1110, 4, 12), (0b1111, 4, 32))


def _put_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Concatenated big-endian bit fields; a byte is opened as soon as the one before is full."""
    total = int(widths.sum())
    at = np.arange(total) - np.repeat(np.cumsum(widths) - widths, widths)
    shift = np.repeat(widths, widths) - 1 - at
    bits = (np.repeat(values.astype(np.uint64), widths) >> shift.astype(np.uint64)) & np.uint64(1)
    return np.packbits(np.append(bits.astype(np.uint8), np.zeros(8 - total % 8, np.uint8))).tobytes()


def dod_encode(values: np.ndarray) -> bytes:
    """u32 values by deltas of deltas: two raw values, then prefix codes with two's complement fields."""
    v = values.astype(np.uint32)
    if len(v) < 3:
        return _put_bits(v.astype(np.uint64), np.full(len(v), 32))
    dod = np.diff(np.diff(v)).view(np.int32).astype(np.int64)
    kind = np.full(len(dod), 4)
    for k, (low, high) in reversed(list(enumerate(((0, 0), (-63, 64), (-255, 256), (-2047, 2048))))):
        kind[(dod >= low) & (dod <= high)] = k
    prefix, size, width = (np.array(x)[kind] for x in zip(*_PREFIX, strict=True))
    field = dod.astype(np.uint64) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))
    return _put_bits(np.concatenate((v[:2].astype(np.uint64), (prefix.astype(np.uint64) << width.astype(np.uint64)) | field)), np.concatenate((np.full(2, 32), size + width)))


def _fields(bits: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The numbers of ``width`` bits at these places."""
    return bits[at[:, None] + np.arange(width)] @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))


def _chain(after: np.ndarray, start: int, n: int) -> np.ndarray:
    """The first ``n`` places of the chain from ``start``, by pointer doubling: what is known goes on from where it ends, all at once."""
    places = np.array([start])
    while len(places) < n:
        places = np.concatenate((places, after[places]))
        after = after[after]
    return places[:n]


def dod_decode(data: bytes, n: int) -> np.ndarray:
    """``n`` u32 values again; a field above half of its range stands for a negative number.

    Where a code ends is worked out for every bit at which one could begin; the
    places of the codes are the chain from the first.
    """
    raw = np.unpackbits(np.frombuffer(data, np.uint8))
    if len(raw) < 32 * min(n, 2) or n < 1:
        return np.zeros(0, np.uint32)
    bits = np.concatenate((raw, np.zeros(40, np.uint8))).astype(np.int64)
    first = _fields(bits, 32 * np.arange(min(n, 2)), 32)
    if n < 3:
        return first.astype(np.uint32)
    ones, lead = np.zeros(len(raw), np.int64), np.ones(len(raw), np.int64)
    for k in range(4):
        lead = lead * bits[k : k + len(raw)]
        ones += lead
    size, width = (np.array(x) for x in list(zip(*_PREFIX, strict=True))[1:])
    after = np.minimum(np.arange(len(raw)) + (size + width)[ones], len(raw) - 1)
    at = _chain(after, 64, n - 2)
    kind, dod = ones[at], np.zeros(n - 2, np.int64)
    for k, (_, lead_bits, bits_of_value) in enumerate(_PREFIX):
        here = np.flatnonzero(kind == k) if bits_of_value else np.zeros(0, np.int64)
        if len(here):
            found = _fields(bits, at[here] + lead_bits, bits_of_value)
            dod[here] = np.where(found > 1 << (bits_of_value - 1), found - (1 << bits_of_value), found)
    steps = np.concatenate(([first[1] - first[0]], dod)).cumsum()
    return ((first[0] + np.concatenate(([0], steps.cumsum()))) & 0xFFFFFFFF).astype(np.uint32)


def byte_rle_encode(data: bytes) -> bytes:
    """Pairs of count and byte; runs over 255 are continued in another pair."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return b""
    first = np.flatnonzero(np.concatenate(([True], raw[1:] != raw[:-1])))
    length = np.diff(np.append(first, len(raw)))
    pairs = -(-length // 255)
    counts = np.full(int(pairs.sum()), 255)
    counts[np.cumsum(pairs) - 1] = length - (pairs - 1) * 255
    return np.stack([counts.astype(np.uint8), np.repeat(raw[first], pairs)], axis=1).tobytes()


def byte_rle_decode(data: bytes) -> bytes:
    """The bytes again."""
    pairs = np.frombuffer(data, np.uint8).reshape(-1, 2)
    return np.repeat(pairs[:, 1], pairs[:, 0]).tobytes()
