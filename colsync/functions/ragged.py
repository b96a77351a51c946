"""Rows of bytes of different lengths, as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.uint8)
    at = np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return data[at]


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def to_binary(data: np.ndarray, sizes: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """A binary array of consecutive pieces."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    mask = None if null is None or not null.any() else pa.array(~null).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [mask, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def interleave(columns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Row-major bytes of columns given as ``(data, sizes)``, and the size of each row."""
    rows = len(columns[0][1])
    sizes = np.stack([s for _, s in columns], axis=1)
    base = np.cumsum([0, *(len(d) for d, _ in columns)])[:-1]
    starts = np.stack([b + np.cumsum(s) - s for b, (_, s) in zip(base, columns, strict=True)], axis=1)
    data = np.concatenate([d for d, _ in columns]) if rows else np.zeros(0, np.uint8)
    return gather(data, starts.ravel(), sizes.ravel()), sizes.sum(axis=1)


def spans(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``limit`` bytes together, one at least."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi
        lo = hi
