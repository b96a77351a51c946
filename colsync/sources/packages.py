"""Packages on the wire: a sink that writes them as they would be sent, with commit and abort, and a reader that frames them.

A file is a row of packages, each a header (tag 1 and seven numbers) and its
payload, and an end record (tag 2): start of the first package, events, original
and compressed bytes of all.  A file that has no end, or one that doesn't agree
with what came before, is not whole and raises.

Tasks write files under names that nobody reads.  The driver's commit moves them
and then writes their names to a list of its own; readers read only listed files.
So a task that fails, a job that is aborted and a commit that is cut short
leave nothing that counts, and a batch of a stream that is tried again replaces
its list.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

from colsync.operators.transport import HEADER_BYTES, TAG, TAG_END
from colsync.sources.store import open_file, store

SCHEMA = "package_file string, package_no long, header binary, payload binary"
#: Bytes after which a task begins another file, and packages that a batch of rows has at most.
FILE_BYTES, ROWS = 128 << 20, 256
_HEAD, _END = struct.Struct("<H7Q"), struct.Struct("<H4Q")


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, under the names that they have until the commit."""

    files: list[str]


class Totals:
    """What an end record says, counted package by package."""

    def __init__(self):
        self.start, self.events, self.ori, self.cmpr = 0, 0, 0, 0

    def add(self, header: bytes) -> int:
        """Count a package; the length of its payload."""
        tag, ori, cmpr, start, events, *_ = _HEAD.unpack(header)
        if tag != TAG:
            raise ValueError("not a package")
        self.start = self.start if self.events or self.ori else start
        self.events, self.ori, self.cmpr = self.events + events, self.ori + ori, self.cmpr + cmpr
        return cmpr

    def record(self) -> bytes:
        return _END.pack(TAG_END, self.start, self.events, self.ori, self.cmpr)


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """Packages, ``header`` and ``payload``, in the order in which they come; what an error leaves is deleted."""
    fs, inner = store(folder)
    fs.create_dir(inner)
    done, out, totals, size = [], None, Totals(), 0
    try:
        for batch in batches:
            headers, payloads = (batch.column(batch.schema.get_field_index(c)) for c in ("header", "payload"))
            for i in range(batch.num_rows):
                header, payload = headers[i].as_py(), payloads[i].as_buffer()
                if out is None:
                    done.append(f".part-{uuid.uuid4().hex}")
                    out, totals, size = fs.open_output_stream(f"{inner}/{done[-1]}"), Totals(), 0
                if header is None or len(header) != HEADER_BYTES or totals.add(header) != payload.size:
                    raise ValueError("a package's header doesn't go with its payload")
                out.write(header)
                out.write(payload)
                size += HEADER_BYTES + payload.size
                if size >= FILE_BYTES:
                    out.write(totals.record())
                    out.close()
                    out = None
        if out is not None:
            out.write(totals.record())
            out.close()
    except BaseException:
        if out is not None:
            out.close()
        _delete(folder, done)
        raise
    return Written(done)


def _delete(folder: str, names: list[str]) -> None:
    fs, inner = store(folder)
    for name in names:
        if fs.get_file_info(f"{inner}/{name}").type == pafs.FileType.File:
            fs.delete_file(f"{inner}/{name}")


def _lists(folder: str) -> dict[str, list[str]]:
    """The committed files by the name of their list."""
    fs, inner = store(folder)
    if fs.get_file_info(inner).type != pafs.FileType.Directory:
        return {}
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(inner)):
        if info.base_name.startswith("_commit-"):
            with fs.open_input_file(info.path) as file:
                out[info.base_name] = json.loads(file.read())
    return out


def _commit(folder: str, messages: list, name: str, replace: bool) -> None:
    """Move the files of all tasks and list them; lists that this one replaces go after it is there, with their files."""
    fs, inner = store(folder)
    fs.create_dir(inner)
    old = _lists(folder)
    gone = old if replace else {k: v for k, v in old.items() if k == name}
    files = [(f, f"packages-{f.removeprefix('.part-')}") for m in messages if m is not None for f in m.files]
    for made, final in files:
        fs.move(f"{inner}/{made}", f"{inner}/{final}")
    fresh = f"{inner}/.list-{uuid.uuid4().hex}"
    with fs.open_output_stream(fresh) as out:
        out.write(json.dumps([final for _, final in files]).encode())
    fs.move(fresh, f"{inner}/{name}")
    for k, found in gone.items():
        _delete(folder, [*found, *([k] if k != name else [])])


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.name = folder, overwrite, f"_commit-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.folder, iterator)

    def commit(self, messages: list) -> None:
        _commit(self.folder, messages, self.name, self.overwrite)

    def abort(self, messages: list) -> None:
        _delete(self.folder, [f for m in messages if m is not None for f in m.files])


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.folder, iterator)

    def commit(self, messages: list, batchId: int) -> None:
        _commit(self.folder, messages, f"_commit-batch-{batchId}", False)

    def abort(self, messages: list, batchId: int) -> None:
        _delete(self.folder, [f for m in messages if m is not None for f in m.files])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def read_file(path: str) -> Iterator[tuple[bytes, bytes]]:
    """``(header, payload)`` of each package of a file, up to its end record; a file that is not whole raises."""
    with open_file(path) as file:

        def exactly(n: int) -> bytes:
            data = file.read(n)
            if len(data) < n:
                raise EOFError(f"{path}: {n - len(data)} bytes are missing at {file.tell()}")
            return data

        totals = Totals()
        while True:
            tag = exactly(2)
            if tag == TAG.to_bytes(2, "little"):
                header = tag + exactly(HEADER_BYTES - 2)
                yield header, exactly(totals.add(header))
            elif tag == TAG_END.to_bytes(2, "little"):
                if tag + exactly(_END.size - 2) != totals.record() or file.read(1):
                    raise ValueError(f"{path}: the end doesn't agree with the packages")
                return
            else:
                raise ValueError(f"{path}: no tag at {file.tell() - 2}")


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_File]:
        base = self.folder.rstrip("/")
        return [_File(f"{base}/{f}") for name, found in sorted(_lists(self.folder).items()) for f in found]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives where there are no files
            return
        name, rows, number = partition.path.rsplit("/", 1)[1], [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([name] * len(rows), pa.string()), pa.array(range(number - len(rows), number), pa.int64()), pa.array([h for h, _ in rows], pa.binary()), pa.array([p for _, p in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["package_file", "package_no", "header", "payload"])

        for found in read_file(partition.path):
            rows.append(found)
            number += 1
            if len(rows) == ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()


class PackageDataSource(DataSource):
    """``format("packages")``: writes ``header, payload`` to a folder, as a batch or a stream, and reads them back.

    A task's packages are in its files in the order of its rows, so whoever
    needs an order deals and sorts the rows before.
    """

    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"])


def send(packages: DataFrame, folder: str, mode: str = "append") -> None:
    """Write packages, those of a file one after the other in the order of their blocks."""
    packages.sparkSession.dataSource.register(PackageDataSource)
    ordered = packages.repartition("file").sortWithinPartitions("file", "block_no").select("header", "payload")
    ordered.write.format("packages").mode(mode).save(folder)


def receive(spark: SparkSession, folder: str) -> DataFrame:
    """The packages of all commits: ``package_file, package_no, header, payload``."""
    spark.dataSource.register(PackageDataSource)
    return spark.read.format("packages").load(folder)
