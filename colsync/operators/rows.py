"""Row images: decoded a column at a time for all rows of a table, and encoded the same way.

The images of a batch lie in one byte array.  A cursor for each row moves over
them column by column, so every step is an array operation over all rows, also
for columns with length prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsync.functions.mysql import TYPES, TableInfo, datetime2_micros, decimal_texts, pack_datetime2, parse_table_map, time2_texts, width
from colsync.functions.ragged import binary_buffers, gather, interleave, to_binary

CHECKSUM = 4


def decode_images(data: np.ndarray, starts: np.ndarray, included: np.ndarray, nulls: np.ndarray, info: TableInfo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, sizes`` of each value, ``(rows, columns)``, -1 where there is none, and where each row ends.

    ``included`` and ``nulls`` are boolean, ``(rows, columns)``; a null bit
    counts among the included columns, as the log stores it.
    """
    rows, n = included.shape
    at = starts.astype(np.int64).copy()
    first, size = np.full((rows, n), -1, np.int64), np.full((rows, n), -1, np.int64)
    order = np.cumsum(included, axis=1) - 1
    for c, (code, meta) in enumerate(zip(info.types, info.meta, strict=True)):
        there = included[:, c] & ~nulls[np.arange(rows), np.maximum(order[:, c], 0)]
        if not there.any():
            continue
        fixed, prefix = width(code, meta)
        have = np.full(rows, fixed, np.int64)
        if prefix:
            have = np.zeros(rows, np.int64)
            for i in range(prefix):
                have += data[np.minimum(at + i, len(data) - 1)].astype(np.int64) << (8 * i)
            have += prefix
        have = np.where(there, have, 0)
        first[:, c], size[:, c] = np.where(there, at, -1), np.where(there, have, -1)
        at += have
    return first, size, at


def _bits(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """``n`` flags from the bitmap of each row."""
    raw = data[starts[:, None] + np.arange((n + 7) // 8)]
    return np.unpackbits(raw, axis=1, bitorder="little")[:, :n].astype(bool)


IMAGES = "file string, packet_no long, table_id long, row_no int, included binary, nulls binary, values array<binary>, checksum binary"
#: Tables whose definitions the driver holds in ``registry_of``, and tasks that the rows of a table are dealt to in a join.
MAX_TABLES, SALTS = 1_000_000, 16


def _definition(table: int, data: bytes | None) -> TableInfo:
    if data is None:
        raise ValueError(f"rows of table {table} have no TABLE_MAP before them")
    return parse_table_map(data)[1]


def _decode(batches: Iterator[pa.RecordBatch], registry: dict[int, TableInfo] | None, keep: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """``registry`` has the definitions, or each row has its own in the column ``definition``."""
    for batch in batches:
        data, offsets = binary_buffers(batch.column("data"))
        tables = batch.column("table_id").to_numpy(zero_copy_only=False)
        for table, at in zip(*np.unique(tables, return_index=True), strict=True):
            if registry is None:
                info = _definition(int(table), batch.column("definition")[int(at)].as_py())
            elif int(table) not in registry:
                raise ValueError(f"rows of table {table} have no TABLE_MAP before them")
            else:
                info = registry[int(table)]
            pick = np.flatnonzero(tables == table)
            begin, end = offsets[pick], offsets[pick + 1]
            extra = data[begin + 8].astype(np.int64) | data[begin + 9].astype(np.int64) << 8
            n = len(info.types)
            k = (n + 7) // 8
            maps = begin + 8 + extra + 1
            if (data[maps - 1] != n).any():
                raise ValueError(f"rows of table {table} don't have its {n} columns")
            included, cursor, row_no = _bits(data, maps, n), maps + k, 0
            while len(pick):
                image = cursor + k
                starts, sizes, at = decode_images(data, image, included, _bits(data, cursor, n), info)
                if (at > end - CHECKSUM).any():
                    raise ValueError(f"a row image of table {table} is cut short")
                flat = np.maximum(sizes, 0).ravel()
                values = to_binary(gather(data, np.maximum(starts, 0).ravel(), flat), flat, (sizes < 0).ravel())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(pick) + 1) * n, pa.int32()), values)
                piece = lambda start, size: to_binary(gather(data, start, np.full(len(start), size)), np.full(len(start), size))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column("file").take(pa.array(pick)), batch.column("packet_no").take(pa.array(pick)), pa.array(np.full(len(pick), table, np.int64)), pa.array(np.full(len(pick), row_no, np.int32)), piece(maps, k), piece(cursor, k), listed, piece(end - CHECKSUM, CHECKSUM), *(batch.column(c).take(pa.array(pick)) for c in keep)],
                    names=["file", "packet_no", "table_id", "row_no", "included", "nulls", "values", "checksum", *keep],
                )
                more = at < end - CHECKSUM
                pick, end, maps, included, cursor, row_no = pick[more], end[more], maps[more], included[more], at[more], row_no + 1


def row_images(write_rows: DataFrame, registry: dict[int, TableInfo] | DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row image of WRITE_ROWS events: ``file, packet_no, table_id, row_no, included, nulls, values, checksum``.

    ``write_rows`` has ``file, packet_no, table_id`` and the event ``data``.  A
    value that is not included or null is null; length prefixes stay in the
    values, as in the log.  Several images in an event are taken one after the
    other until the checksum is left.  ``keep`` are columns of ``write_rows`` to
    carry along.

    ``registry`` is a dictionary, which is broadcast, or a table of any number
    of definitions (``definitions_of``), which meets the rows in a join: rows of
    a table are dealt to ``SALTS`` tasks, with a copy of its definition in each.
    """
    schema = ", ".join([IMAGES, *(f"`{f.name}` {f.dataType.simpleString()}" for f in write_rows.schema if f.name in keep)])
    rows = write_rows.select("file", "packet_no", "table_id", "data", *keep)
    if isinstance(registry, DataFrame):
        salted = registry.select("table_id", "definition", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("file", "packet_no"), F.lit(SALTS)).cast("int")).join(salted, ["table_id", "_salt"], "left")
        return joined.select(*rows.columns, "definition").mapInArrow(lambda batches: _decode(batches, None, keep), schema)
    held = write_rows.sparkSession.sparkContext.broadcast(registry)
    return rows.mapInArrow(lambda batches: _decode(batches, held.value, keep), schema)


def definitions_of(table_maps: DataFrame) -> DataFrame:
    """The definitions as a table, ``table_id, definition``; the first TABLE_MAP of an id counts for good.

    ``table_maps`` has ``file, packet_no, table_id, data``.
    """
    return table_maps.groupBy("table_id").agg(F.min(F.struct("file", "packet_no", "data"))["data"].alias("definition"))


def registry_of(table_maps: DataFrame) -> dict[int, TableInfo]:
    """The definitions by table id; the first TABLE_MAP of an id counts for good.

    For logs of few tables: the driver holds a short row for each, ``MAX_TABLES``
    at most, and raises beyond; ``definitions_of`` has no bound.
    """
    first = definitions_of(table_maps).limit(MAX_TABLES + 1).collect()
    if len(first) > MAX_TABLES:
        raise ValueError(f"more than {MAX_TABLES} tables in a log")
    return {r.table_id: parse_table_map(bytes(r.definition))[1] for r in first}


# -- typed values -------------------------------------------------------------


def spark_type(code: int, meta: int) -> str:
    """The Spark type of a column's typed view."""
    if code == TYPES["NEWDECIMAL"]:
        return f"decimal({meta >> 8},{meta & 0xFF})" if meta >> 8 <= 38 else "string"
    names = {1: "tinyint", 2: "smallint", 9: "int", 3: "int", 8: "bigint", 4: "float", 5: "double", 13: "int", 7: "timestamp", 18: "timestamp_ntz", 10: "date", 19: "string", 15: "string", 253: "string", 254: "string", 6: "void"}
    return names.get(code, "binary")


def _typed(values: pa.Array, code: int, meta: int) -> pa.Array:
    """One column of binary values as its Arrow type."""
    null = values.is_null().to_numpy(zero_copy_only=False)
    data, offsets = binary_buffers(values)
    fixed, prefix = width(code, meta)
    if prefix and code in (15, 253, 254):
        sizes = np.maximum(np.diff(offsets) - prefix, 0)
        return to_binary(gather(data, offsets[:-1] + np.where(sizes > 0, prefix, 0), sizes), sizes, null).cast(pa.string())
    if spark_type(code, meta) == "binary" or prefix:
        return values
    raw = np.zeros((len(values), fixed), np.uint8)
    raw[~null] = data.reshape(-1, fixed) if fixed else raw[~null]
    plain = {1: "<i1", 2: "<i2", 3: "<i4", 8: "<i8", 4: "<f4", 5: "<f8"}
    if code in plain:
        return pa.array(raw.reshape(-1).view(plain[code]), mask=null)
    number = raw.astype(np.int64) @ (1 << np.arange(0, 8 * fixed, 8, dtype=np.int64)) if fixed < 8 else None
    if code == 9:
        return pa.array(np.where(number >> 23, number - (1 << 24), number).astype(np.int32), mask=null)
    if code == 13:
        return pa.array(np.where(number, number + 1900, 0).astype(np.int32), mask=null)
    if code == 7:
        return pa.array(number * 1_000_000, mask=null).cast(pa.timestamp("us", "UTC"))
    if code == 10:
        year, month, day = number // 512, number // 32 % 16, number % 32
        bad = null | (month == 0) | (day == 0)
        months = ((np.where(bad, 1970, year) - 1970) * 12 + np.where(bad, 1, month) - 1).astype("datetime64[M]")
        return pa.array((months.astype("datetime64[D]").astype(np.int64) + np.where(bad, 1, day) - 1).astype(np.int32), mask=bad).cast(pa.date32())
    if code == 18:
        micros = datetime2_micros(raw, meta)
        return pa.array(micros, mask=null | (micros == np.iinfo(np.int64).min)).cast(pa.timestamp("us"))
    out = to_binary(*(time2_texts(raw, meta) if code == 19 else decimal_texts(raw, meta >> 8, meta & 0xFF)), null).cast(pa.string())
    return out.cast(pa.decimal128(meta >> 8, meta & 0xFF)) if spark_type(code, meta).startswith("decimal") else out


def typed_rows(images: DataFrame, info: TableInfo, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The row images of one table with a typed column for each of its columns.

    The log has no column names, so ``names`` gives them; ``keep`` are columns of
    ``images`` to carry along.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name in keep), *(f"`{n}` {spark_type(c, m)}" for n, c, m in zip(names, info.types, info.meta, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = batch.column("values").flatten(), len(info.types)
            at = np.arange(batch.num_rows) * n
            columns = [_typed(flat.take(pa.array(at + i)), c, m) for i, (c, m) in enumerate(zip(info.types, info.meta, strict=True))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns], names=[*keep, *names])

    return images.select(*keep, "values").mapInArrow(run, schema)


# -- encoding -----------------------------------------------------------------


def _encoded(column: pa.Array, code: int, meta: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of a column's values in a row image; null takes nothing."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    if code in (15, 252, 253, 245):
        data, offsets = binary_buffers(column.cast(pa.binary()) if pa.types.is_string(column.type) else column)
        sizes = np.diff(offsets)
        prefix = width(code, meta)[1]
        heads = np.stack([sizes >> (8 * i) & 255 for i in range(prefix)], axis=1).astype(np.uint8)
        there = (~null).astype(np.int64)
        return interleave([(heads[~null].ravel(), there * prefix), (data, sizes)])
    if code == 18:
        raw = pack_datetime2(column.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(0).to_numpy(), meta)
    else:
        plain = {1: "<i1", 2: "<i2", 3: "<i4", 8: "<i8", 4: "<f4", 5: "<f8"}
        if code not in plain:
            raise ValueError(f"{code} can't be encoded here")
        values = column.fill_null(0).to_numpy(zero_copy_only=False).astype(plain[code])
        raw = values.view(np.uint8).reshape(len(values), -1)
    return raw[~null].ravel(), np.where(null, 0, raw.shape[1])


def encode_images(df: DataFrame, info: TableInfo, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, ``nulls`` (the bitmap) and ``image`` of each row, all columns included."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep), "nulls binary", "image binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [_encoded(batch.column(c), code, meta) for c, code, meta in zip(columns, info.types, info.meta, strict=True)]
            data, sizes = interleave(parts)
            flags = np.stack([batch.column(c).is_null().to_numpy(zero_copy_only=False) for c in columns], axis=1)
            bits = np.packbits(flags, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), to_binary(bits.ravel(), np.full(len(bits), bits.shape[1])), to_binary(data, sizes)], names=[*keep, "nulls", "image"])

    return df.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, schema)
