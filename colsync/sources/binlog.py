"""Logs of packets: a Python data source for batch reads, and a writer of synthetic logs; ``manifest`` has the stream.

A packet is a 3-byte little-endian body length, a sequence number and the body,
which begins with a flag; the body of an event follows with its 19-byte header.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from colsync.functions.binary import to_little_endian
from colsync.functions.ragged import to_binary
from colsync.sources.framing import CHUNK, find_parts
from colsync.sources.store import open_file, sized_files, store

SCHEMA = "file string, packet_no long, offset long, body_len int, seq smallint, flag smallint, body binary"
#: Packets of a batch, and bytes of a file that one task reads, about.
ROWS, SPLIT = 20_000, 128 << 20
#: Event kinds.
EVENTS = {
    "STOP": 3, "QUERY": 2, "ROTATE": 4, "FORMAT_DESCRIPTION": 15, "XID": 16, "TABLE_MAP": 19, "WRITE_ROWS_V0": 20, "WRITE_ROWS_V1": 23, "WRITE_ROWS": 30,
    "UPDATE_ROWS": 31, "DELETE_ROWS": 32, "GTID": 33, "ANONYMOUS_GTID": 34, "PREVIOUS_GTIDS": 35, "TRANSACTION_PAYLOAD": 40,
}
NAMES = {code: name for name, code in EVENTS.items()}


def read_part(path: str, start: int = 0, stop: int | None = None, first: int = 0) -> Iterator[pa.RecordBatch]:
    """The packets of a file from one boundary to another, some MB at a time; one that is cut short at the end raises."""
    name = os.path.basename(path)
    with open_file(path) as file:
        file.seek(start)
        at, held = start, b""
        while True:
            read = file.read(CHUNK if stop is None else min(CHUNK, stop - at - len(held)))
            held += read
            places, low, size = [], 0, len(held)
            while low + 4 <= size:
                end = low + 4 + (held[low] | held[low + 1] << 8 | held[low + 2] << 16)
                if end > size:
                    break
                places.append(low)
                low = end
            for i in range(0, len(places), ROWS):
                cut = np.array([*places[i : i + ROWS], places[i + ROWS] if i + ROWS < len(places) else low], np.int64)
                yield _batch(name, first, at, np.frombuffer(held, np.uint8)[cut[0] : cut[-1]], cut - cut[0], int(cut[0]))
                first += len(cut) - 1
            at, held = at + low, held[low:]
            if not read:
                break
    if held:
        raise EOFError(f"{path}: {len(held)} bytes at {at} are no whole packet")


def _batch(name: str, first: int, base: int, data: np.ndarray, cut: np.ndarray, shift: int) -> pa.RecordBatch:
    """Packets as rows, from their bytes and where each begins."""
    begin, size = cut[:-1], np.diff(cut) - 4
    flagged = size > 0
    body = np.ones(len(data), bool)
    for i in range(4):
        body[begin + i] = False
    body[begin[flagged] + 4] = False
    flag = data[np.minimum(begin + 4, len(data) - 1)].astype(np.int16)
    columns = [pa.array([name] * len(begin), pa.string()), pa.array(first + np.arange(len(begin))), pa.array(base + shift + begin), pa.array(size.astype(np.int32)), pa.array(data[begin + 3].astype(np.int16)), pa.array(flag, mask=~flagged), to_binary(data[body], np.maximum(size - 1, 0))]
    return pa.RecordBatch.from_arrays(columns, names=["file", "packet_no", "offset", "body_len", "seq", "flag", "body"])


def read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over ``path, start, stop, first``: the packets of these parts."""
    for batch in batches:
        for path, start, stop, first in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop", "first")), strict=True):
            yield from read_part(path, start, stop, first)


class _File(InputPartition):
    def __init__(self, path: str, start: int = 0, stop: int | None = None, first: int = 0):
        self.path, self.start, self.stop, self.first = path, start, stop, first


class _Reader(DataSourceReader):
    def __init__(self, path: str, splits: str | None):
        self.path, self.splits = path, splits

    def partitions(self) -> list[_File]:
        if self.splits:
            return [_File(*x) for x in json.loads(self.splits)]
        return [_File(f) for f, _ in sized_files(self.path)]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        # Spark gives none where there are no files
        return read_part(partition.path, partition.start, partition.stop, partition.first) if partition else iter(())


class BinlogDataSource(DataSource):
    """``spark.read.format("binlog").load(path)``: packets of a file, a folder or a local pattern.

    A partition is a file, or a part of one where the option ``splits`` says so
    (see ``read_packets``).
    """

    @classmethod
    def name(cls) -> str:
        return "binlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("splits"))


def read_packets(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """The packets of a log: ``file, packet_no, offset, body_len, seq, flag, body``; the body is without the flag.

    Files of more than ``split_bytes`` are read in parts, whose boundaries are
    found in parts as well (``framing``): no task goes over more than a part of a
    file.  Bytes at the end that are no whole packet raise.
    """
    spark.dataSource.register(BinlogDataSource)
    files, reader = sized_files(path), spark.read.format("binlog")
    if any(size > split_bytes for _, size in files):
        parts, ends = find_parts(spark, [(f, 0, 0, size) for f, size in files if size > split_bytes], split_bytes)
        splits = [(p.path, p.start, p.stop, p.first) for p in parts] + [(f, 0, None, 0) for f, size in files if size <= split_bytes]
        # the reader says what is wrong with the rest
        splits += [(f, ends[f][0], None, ends[f][1]) for f, size in files if f in ends and ends[f][0] < size]
        reader = reader.option("splits", json.dumps(sorted(splits, key=lambda x: x[:2])))
    return reader.load(path)


# -- writing logs ---------------------------------------------------------------


def write_log(packets: DataFrame, folder: str) -> None:
    """Packets as logs, a file for each ``file`` in the order of ``packet_no``; files of these names are replaced.

    A file is written under a name of its attempt and then moved, so a task that
    is tried again or twice leaves whole files only.  A file streams through one
    task, as its bytes follow one another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = store(folder)
        fs.create_dir(inner)
        name, out, part, done = None, None, f"{inner}/.part-{uuid.uuid4().hex}", []

        def finish() -> None:
            out.close()
            fs.move(part, f"{inner}/{name}")
            done.append(name)

        for batch in batches:
            for file, seq, flag, body in zip(*(batch.column(c).to_pylist() for c in ("file", "seq", "flag", "body")), strict=True):
                if out is None or file != name:
                    if out is not None:
                        finish()
                    name, out = file, fs.open_output_stream(part)
                out.write(packet(body, seq, flag))
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    sorted_ = packets.select("file", "packet_no", "seq", "flag", "body").repartition("file").sortWithinPartitions("file", "packet_no")
    sorted_.mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


# -- synthetic logs -----------------------------------------------------------


def event_body(kind: int, data: bytes, ts: int = 0, server: int = 1, next_pos: int = 0, flags: int = 0) -> bytes:
    """Header and data of an event."""
    return ts.to_bytes(4, "little") + bytes([kind]) + server.to_bytes(4, "little") + (19 + len(data)).to_bytes(4, "little") + next_pos.to_bytes(4, "little") + flags.to_bytes(2, "little") + data


def packet(body: bytes, seq: int = 0, flag: int = 0) -> bytes:
    """A packet with a flag and a body."""
    return (len(body) + 1).to_bytes(3, "little") + bytes([seq & 255, flag]) + body


def write_file(path: str, bodies: Iterable[bytes], flags: Iterable[int] | None = None) -> None:
    """A log of these event bodies."""
    with open(path, "wb") as file:
        for i, (body, flag) in enumerate(zip(bodies, flags if flags is not None else iter(int, 1), strict=False)):
            file.write(packet(body, i, flag))


def event_packets(events: DataFrame, kind, data: Column, ts: Column, by: str, order: list[Column], ranges: str | None = None) -> DataFrame:
    """Packets, as ``read_packets`` gives them, of one event for each row: built by expressions, numbered within ``by``.

    ``ranges`` names a column of numbers that rises with the order.  A file is then
    numbered range by range, each led by the packets and bytes of those before it, and is no single task.
    """
    from pyspark.sql import Window

    kind = kind if isinstance(kind, Column) else F.lit(kind)
    size = F.octet_length("_data")
    rows = events.select(F.col(by).cast("string").alias("file"), (F.col(ranges) if ranges else F.lit(0)).alias("_range"), F.struct(*order).alias("_at"), kind.alias("_kind"), data.alias("_data"), ts.alias("_ts"), F.lit(1).cast("long").alias("_n"), (F.octet_length(data) + 24).cast("long").alias("_size"), F.lit(True).alias("_row"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    if ranges:
        sums = rows.groupBy("file", "_range").agg(F.sum("_n").alias("_n"), F.sum("_size").alias("_size"))
        line = Window.partitionBy("file").orderBy("_range")
        rows = rows.unionByName(sums.select("file", "_range", before("_n", line).alias("_n"), before("_size", line).alias("_size"), F.lit(False).alias("_row")), allowMissingColumns=True)
    inside = Window.partitionBy("file", "_range").orderBy("_row", "_at")
    rows = rows.select("*", before("_n", inside).alias("packet_no"), before("_size", inside).alias("offset")).where("_row")
    zero = lambda n: F.unhex(F.lit("00" * n))
    head = F.concat(to_little_endian(F.col("_ts"), 4), to_little_endian(F.col("_kind"), 1), F.unhex(F.lit("01000000")), to_little_endian(size + 19, 4), zero(4), zero(2))
    return rows.select("file", "packet_no", "offset", (size + 20).cast("int").alias("body_len"), (F.col("packet_no") % 256).cast("smallint").alias("seq"), F.lit(0).cast("smallint").alias("flag"), F.concat(head, "_data").alias("body"))
