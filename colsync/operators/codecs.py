"""General-purpose codecs on binary columns, through Arrow batches.

Spark has no functions that compress a binary value, so each codec is an
Arrow-batched function.  Spark's batches hold up to 64 MB; a function passes its
results on after each ``SLICE`` bytes of them.  A registry maps ids and names to codecs; more can be
registered.  Every encoded value can be decoded: where a codec needs the
original length it is kept in front, and an expansion is simply stored.
"""

from __future__ import annotations

import gzip
import hashlib
import lzma
import struct
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsync.functions.ragged import spans
from colsync.operators.blocks import fixed_chunks
from colsync.operators.lightweight import percent_split


#: Bytes of values that a task codes before it passes the results on, and values whose measurements it remembers.
SLICE, REMEMBERED = 4 << 20, 1 << 16


@dataclass(frozen=True)
class Codec:
    """An encoder and its decoder under an id and a name."""

    id: int
    name: str
    encode: Callable[[bytes], bytes] | None
    decode: Callable[[bytes], bytes] | None

    @property
    def available(self) -> bool:
        return self.encode is not None


@lru_cache(maxsize=16)
def _zstd(level: int):
    """Compressor and decompressor, kept by each worker."""
    import zstandard

    return zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()


def _zstd_codec(level: int) -> tuple[Callable, Callable]:
    return lambda x: _zstd(level)[0].compress(x), lambda x: _zstd(level)[1].decompress(x) if x else b""


def _arrow_codec(name: str) -> tuple[Callable, Callable]:
    """An Arrow codec; the original length leads, as these formats don't all hold it."""
    encode = lambda x: struct.pack("<I", len(x)) + (pa.Codec(name).compress(x, asbytes=True) if x else b"")
    decode = lambda x: pa.Codec(name).decompress(x[4:], struct.unpack_from("<I", x)[0], asbytes=True) if len(x) > 4 else b""
    return encode, decode


def _deflate(x: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(x) + packer.flush()


def _xz(x: bytes) -> bytes:
    """By the usual preset; the dictionary is as long as the value at most, as no match reaches further, so short values don't clear tables of many MB."""
    reach = min(8 << 20, max(4096, 1 << max(len(x) - 1, 0).bit_length()))
    return lzma.compress(x, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": reach}])


def _registry() -> dict[int, Codec]:
    own = (
        Codec(151, "nocompression", lambda x: x, lambda x: x),
        Codec(152, "zstd1", *_zstd_codec(1)),
        Codec(153, "zstd", *_zstd_codec(3)),
        Codec(154, "zstd8", *_zstd_codec(8)),
        Codec(155, "zstd22", *_zstd_codec(19)),
        Codec(156, "snappy", *_arrow_codec("snappy")),
        Codec(157, "lz4", *_arrow_codec("lz4_raw")),
        # no library for it here: the id is kept, and planners leave it out
        Codec(158, "lzo", None, None),
        Codec(159, "gzip", lambda x: gzip.compress(x, 6, mtime=0), gzip.decompress),
        Codec(160, "flate", _deflate, lambda x: zlib.decompress(x, -15)),
        Codec(161, "xz", _xz, lzma.decompress),
        Codec(162, "brotli", *_arrow_codec("brotli")),
    )
    return {c.id: c for c in own}


CODECS = _registry()
NOCOMPRESSION = 151
#: What planners choose from unless told otherwise.
POOL = (151, 152, 153, 154, 155, 156, 157, 159, 160)


def register_codec(codec: Codec) -> None:
    """Add or replace a codec; workers get it with the functions that use it."""
    CODECS[codec.id] = codec


def by_name(name: str) -> Codec:
    """The codec of a name, or a ValueError."""
    for codec in CODECS.values():
        if codec.name == name.lower():
            return codec
    raise ValueError(f"no codec {name!r}")


def codec_name(id_column: Column) -> Column:
    """The name of a codec id."""
    names = F.create_map(*[F.lit(x) for c in CODECS.values() for x in (c.id, c.name)])
    return F.coalesce(names[id_column], F.lit("unknown"))


def _checked(id: int) -> Codec:
    codec = CODECS[id]
    if not codec.available:
        raise ValueError(f"codec {codec.name} has no library here")
    return codec


def _slices(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows that are coded before their results are passed on."""
    return spans(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64), SLICE)


def _available() -> dict[int, Codec]:
    return {k: c for k, c in CODECS.items() if c.available}


def _function(method: str):
    codecs = _available()

    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, values in batches:
            for lo, hi in _slices(values):
                made, held = [], 0
                for i, v in zip(ids.slice(lo, hi - lo).to_pylist(), values.slice(lo, hi - lo), strict=True):
                    made.append(getattr(codecs[i], method)(v.as_py()) if v.is_valid else None)
                    held += len(made[-1] or b"")
                    if held >= SLICE:  # decoded values may be any times as long
                        yield pa.array(made, pa.binary())
                        made, held = [], 0
                if made:
                    yield pa.array(made, pa.binary())

    return run


def encode(value: Column, codec: int | Column) -> Column:
    """The value compressed by a codec, given by id or by a column of ids."""
    if isinstance(codec, int):
        _checked(codec)
        codec = F.lit(codec)
    return _function("encode")(codec, value)


def encode_timed(value: Column, codec: Column) -> Column:
    """``payload`` and ``seconds``: the value compressed by a column of codec ids, and how long that took."""
    codecs = _available()
    kind = pa.struct([("payload", pa.binary()), ("seconds", pa.float64())])

    @F.arrow_udf("payload binary, seconds double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, values in batches:
            for lo, hi in _slices(values):
                rows = []
                for i, v in zip(ids.slice(lo, hi - lo).to_pylist(), values.slice(lo, hi - lo), strict=True):
                    v = v.as_py()
                    began = time.perf_counter()
                    payload = None if v is None else codecs[i].encode(v)
                    rows.append({"payload": payload, "seconds": time.perf_counter() - began})
                yield pa.array(rows, kind)

    return run(codec, value)


def decode(value: Column, codec: int | Column) -> Column:
    """The value again."""
    if isinstance(codec, int):
        _checked(codec)
        codec = F.lit(codec)
    return _function("decode")(codec, value)


_PARTS = pa.list_(pa.struct([("codec", pa.int32()), ("lo", pa.int64()), ("payload", pa.binary())]))


def encode_split(value: Column, percents: list[int], ids: list[int]) -> Column:
    """A value cut by percentages, each part by its own codec: an array of ``codec, lo, payload``."""
    held = [_checked(i) for i in ids]

    @F.arrow_udf("array<struct<codec:int,lo:bigint,payload:binary>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for starts, values in batches:
            for lo, hi in _slices(values):
                made = []
                for at, v in zip(starts.slice(lo, hi - lo).to_pylist(), values.slice(lo, hi - lo), strict=True):
                    v = v.as_py()
                    cuts = zip(held, at, [*at[1:], None], strict=True)
                    made.append([{"codec": c.id, "lo": a, "payload": None if v is None else c.encode(v[a:b])} for c, a, b in cuts])
                yield pa.array(made, _PARTS)

    return run(F.array(*[lo for lo, _ in percent_split(F.octet_length(value).cast("long"), percents)]), value)


def decode_split(parts: Column, n: int) -> Column:
    """The value again from its ``n`` parts, by the codecs that they name."""
    codecs = _available()

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for lo, hi in spans(np.full(len(lists), lists.nbytes // max(1, len(lists))), SLICE):
                pieces = [(x or [])[:n] for x in lists.slice(lo, hi - lo).to_pylist()]
                whole = [len(x) == n and all(p["payload"] is not None for p in x) for x in pieces]
                yield pa.array([b"".join(codecs[p["codec"]].decode(p["payload"]) for p in x) if good else None for x, good in zip(pieces, whole, strict=True)], pa.binary())

    return run(parts)


MEASURED = "ori_len long, cmpr_len long, seconds double, decode_seconds double"


def measure(df: DataFrame, value: str, keys: list[str], codecs: tuple[int, ...] = POOL, sizes: tuple[int, ...] = ()) -> DataFrame:
    """Each value under each codec: ``*keys, codec, ori_len, cmpr_len, seconds, decode_seconds``.

    With ``sizes`` a value counts in pieces of each of them, the last one what is
    left, and ``block_size`` comes after the keys; an empty value has no pieces.
    Times are of this run and differ from run to run.  Values don't leave the
    task that reads them: a row comes out for each codec.  A task measures equal
    values once, as far as it remembers them, and all of them count.
    """
    held = {c: _checked(c) for c in codecs}
    fields = [f for f in df.schema if f.name in keys]
    sized = ["block_size int"] if sizes else []
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *sized, "codec int", MEASURED])
    names = [*keys, *(["block_size"] if sizes else []), "codec", "ori_len", "cmpr_len", "seconds", "decode_seconds"]

    def once(codec: Codec, v: bytes) -> tuple[int, float, float]:
        t = time.perf_counter()
        packed = codec.encode(v)
        u = time.perf_counter()
        codec.decode(packed)
        return len(packed), u - t, time.perf_counter() - u

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[tuple[int, float, float]]] = {}
        for batch in batches:
            owner, block, length, found = [], [], [], []

            def passed_on() -> pa.RecordBatch:
                at = pa.array(np.repeat(np.array(owner, np.int64), len(held)))  # noqa: B023
                plain = [np.repeat(np.array(block, np.int32), len(held))] if sizes else []  # noqa: B023
                told = list(zip(*(x for each in found for x in each), strict=True))  # noqa: B023
                plain += [np.tile(np.array(list(held), np.int32), len(found)), np.repeat(np.array(length, np.int64), len(held)), np.array(told[0], np.int64), *(np.array(x, np.float64) for x in told[1:])]  # noqa: B023
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *map(pa.array, plain)], names=names)  # noqa: B023

            for row, v in enumerate(batch.column(len(keys))):
                whole = v.as_py() or b""
                for size in sizes or (0,):
                    for piece in fixed_chunks(whole, size) if size else (whole,):
                        name = hashlib.blake2b(piece, digest_size=16).digest()
                        if name not in seen:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen[name] = [once(codec, piece) for codec in held.values()]
                        owner.append(row)
                        block.append(size)
                        length.append(len(piece))
                        found.append(seen[name])
                        if len(found) >= 4096:
                            yield passed_on()
                            owner, block, length, found = [], [], [], []
            if found:
                yield passed_on()

    return df.select(*keys, F.col(value).cast("binary")).mapInArrow(run, schema)
