"""Word hashing over Arrow string columns, a few array passes per megabyte of text.

Texts are read as UTF-8 bytes.  The word classes in use put every byte from
0x80 up inside a word, so splitting bytes and splitting code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``: anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on lower-cased text: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i < n, at least."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which close values look unrelated."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of some consecutive rows: byte ranges, hashes and the row of each word."""

    row0: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def row(self) -> np.ndarray:
        """For each word the row it is in, from 0."""
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text each, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_slices(column: pa.Array, word_byte: np.ndarray, lower: bool = True) -> Iterator[Words]:
    """Words of a text column, slice by slice, so that memory follows the longest text and not the batch."""
    data, offsets = text_bytes(column)
    for at, to in slices(offsets):
        part, local = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        if lower:
            part = LOWER[part]
        inside = word_byte[part]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edges = local[1:-1][(local[1:-1] > 0) & (local[1:-1] < len(part))]
            before[edges] = False
            after[edges - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        hashes, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):  # once, but for a text that is longer than a slice
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE_BYTES)))
            low, high = starts[i], ends[j - 1]
            power, inverse = _powers(high - low + 1)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum((part[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=total[1:])
            hashes[i:j] = (total[ends[i:j] - low] - total[starts[i:j] - low]) * inverse[starts[i:j] - low]
            i = j
        yield Words(at, to - at, part, local, starts, ends, mix(hashes), np.searchsorted(starts, local).astype(np.int64))


def word_counts(column: pa.Array, word_byte: np.ndarray) -> np.ndarray:
    """Number of words of each text."""
    data, offsets = text_bytes(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for at, to in slices(offsets):
        part, local = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        inside = word_byte[part]
        first = inside.copy()
        if len(inside):
            first[1:] &= ~inside[:-1]
            edges = local[:-1][local[:-1] < len(part)]
            first[edges] = inside[edges]
        seen = np.zeros(len(part) + 1, np.int64)
        np.cumsum(first, out=seen[1:])
        out[at:to] = seen[local[1:]] - seen[local[:-1]]
    return out
