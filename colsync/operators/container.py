"""Self-describing containers: a block of packets as encoded chunks that decode back byte for byte.

A container is a 4-byte event count, a 4-byte original length and sections in a
fixed order.  A section is its name, its number of chunks and the chunks; a
chunk says its codec, whether its values have one width, its number of values,
the places of the values in the block and its data.  So any reader can take a
container apart without knowing how its columns were planned.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsync.operators import lightweight as lw
from colsync.operators.codecs import by_name

#: Chunk tags.
NONE, DOD, ZSTD, RLE, LZ4, DELTA = 0, 1, 2, 3, 4, 5
VARIABLE, FIXED = 0, 1

#: How each column is encoded; all other columns, user columns among them, by zstd.
COLUMN_CODECS = {"Timestamps": DOD, "ServerIds": RLE, "NextPoses": DELTA, "TableIds": RLE, "TableIds2": RLE, "CheckSums": NONE}
MAGIC = b"CSB1"


def encode_chunk(values: list[bytes], tag: int) -> bytes:
    """A chunk: tag, kind of lengths, number of values, lengths, data; a tag that can't hold the values gives way to zstd."""
    sizes = np.array([len(v) for v in values], np.int64)
    fixed = len(values) > 0 and (sizes == sizes[0]).all()
    width = int(sizes[0]) if fixed else 0
    joined = b"".join(values)
    if (tag in (DOD, DELTA) and width != 4) or (tag == RLE and not width):
        tag = ZSTD
    if tag in (DOD, DELTA):
        numbers = np.frombuffer(joined, "<u4")
        data = lw.dod_encode(numbers) if tag == DOD else lw.delta_encode(numbers)
    elif tag == RLE:
        data = lw.rle_encode(np.frombuffer(joined, np.uint8).reshape(-1, width))
    elif tag == NONE:
        data = joined
    else:
        data = by_name("zstd" if tag == ZSTD else "lz4").encode(joined)
    if fixed:
        lens = struct.pack("<BII", FIXED, len(values), width)
    else:
        packed = by_name("zstd").encode(sizes.astype("<u4").tobytes())
        lens = struct.pack("<BII", VARIABLE, len(values), len(packed)) + packed
    return struct.pack("<BI", tag, len(data)) + lens + data


def decode_chunk(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The values of the chunk at a place, and the place after it."""
    tag, size = struct.unpack_from("<BI", data, at)
    kind, n, extra = struct.unpack_from("<BII", data, at + 5)
    at += 14
    if kind == FIXED:
        sizes = np.full(n, extra)
    else:
        sizes = np.frombuffer(by_name("zstd").decode(data[at : at + extra]), "<u4").astype(np.int64) if n else np.zeros(0, np.int64)
        at += extra
    body = data[at : at + size]
    if tag == DOD:
        joined = lw.dod_decode(body, n).astype("<u4").tobytes()
    elif tag == DELTA:
        joined = lw.delta_decode(body).astype("<u4").tobytes()
    elif tag == RLE:
        joined = lw.rle_decode(body, extra).tobytes()
    elif tag == NONE:
        joined = body
    else:
        joined = by_name("zstd" if tag == ZSTD else "lz4").decode(body) if sizes.sum() else b""
    ends = np.cumsum(sizes)
    return [joined[e - s : e] for s, e in zip(sizes, ends, strict=True)], at + size


def encode_block(columns: dict[str, tuple[list[int], list[bytes]]], n_events: int, ori_len: int) -> bytes:
    """A container of ``name -> (places, values)``, in the order of the names."""
    out = [MAGIC, struct.pack("<III", n_events, ori_len, len(columns))]
    for name in sorted(columns):
        places, values = columns[name]
        coded = name.encode()
        out.append(struct.pack("<H", len(coded)) + coded)
        steps = np.diff(np.array(places, np.int64), prepend=0).astype(np.uint64)
        index = by_name("zstd").encode(lw.varint_encode(steps))
        out.append(struct.pack("<I", len(index)) + index)
        out.append(encode_chunk(values, COLUMN_CODECS.get(name, ZSTD)))
    return b"".join(out)


def chunks(data: bytes) -> Iterator[tuple[str, list[int], list[bytes]]]:
    """``name, places, values`` of each column of a container."""
    if data[:4] != MAGIC:
        raise ValueError("not a container")
    _, _, n = struct.unpack_from("<III", data, 4)
    at = 16
    for _ in range(n):
        (size,) = struct.unpack_from("<H", data, at)
        name, at = data[at + 2 : at + 2 + size].decode(), at + 2 + size
        (size,) = struct.unpack_from("<I", data, at)
        places = np.cumsum(lw.varint_decode(by_name("zstd").decode(data[at + 4 : at + 4 + size])).astype(np.int64)).tolist()
        values, at = decode_chunk(data, at + 4 + size)
        yield name, places, values


def encode_blocks(columns: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Containers: ``*keys, n_events, ori_len, cmpr_len, container``.

    ``columns`` come from ``transpose``, ``blocks`` have ``n_events`` and
    ``ori_len``.  One group is one block.
    """
    joined = columns.select(*keys, "column_name", "values", "lens", "places").join(blocks.select(*keys, "n_events", F.col("ori_len").alias("_ori")), keys)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema if f.name in keys), "n_events long, ori_len long, cmpr_len long, container binary"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for r in rows.itertuples(index=False):
            ends = np.cumsum(r.lens)
            held[r.column_name] = (list(r.places), [bytes(r.values[e - n : e]) for n, e in zip(r.lens, ends, strict=True)])
        first = rows.iloc[0]
        data = encode_block(held, int(first["n_events"]), int(first["_ori"]))
        return pd.DataFrame([[*(first[k] for k in keys), first["n_events"], first["_ori"], len(data), data]], columns=[*keys, "n_events", "ori_len", "cmpr_len", "container"])

    return joined.groupBy(*keys).applyInPandas(run, schema)


def decode_blocks(containers: DataFrame, keys: list[str]) -> DataFrame:
    """The values of all columns: ``*keys, column_name, place, value``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in containers.schema if f.name in keys), "column_name string, place long, value binary"])

    def run(batches):
        for pdf in batches:
            for container, *held in zip(pdf["container"], *(pdf[k] for k in keys), strict=True):
                for name, places, values in chunks(bytes(container)):
                    yield pd.DataFrame({**dict(zip(keys, held, strict=True)), "column_name": name, "place": places, "value": values})

    return containers.select(*keys, "container").mapInPandas(run, schema)


def restore_packets(values: DataFrame, keys: list[str]) -> DataFrame:
    """Packets from the decoded values of a block: ``*keys, place, packet``, the bytes as they were read.

    Header columns come first, then the data: a body that is a column of its own,
    or the fields of a table map or of rows in wire order, with user columns by
    number between the null bitmap and the checksum.
    """
    from colsync.operators.columns import HEADER_COLUMNS, ROW_COLUMNS, TABLE_COLUMNS, WHOLE_COLUMNS

    order = [*HEADER_COLUMNS, *WHOLE_COLUMNS.values(), *TABLE_COLUMNS, *ROW_COLUMNS[:-1]]
    rank = F.create_map(*[F.lit(x) for i, n in enumerate(order) for x in (n, i)])
    number = F.when(F.col("column_name").contains(":"), F.split("column_name", ":")[1].cast("int") + 1000).when(F.col("column_name") == ROW_COLUMNS[-1], 1_000_000).otherwise(rank[F.col("column_name")])
    numbered = values.withColumn("_rank", number)
    return numbered.groupBy(*keys, "place").agg(F.expr("listagg(value) WITHIN GROUP (ORDER BY _rank)").alias("packet"))
