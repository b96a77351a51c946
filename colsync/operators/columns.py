"""Turning blocks of packets into columns of bytes and back, and cutting those columns.

A column is the concatenation of its values in packet order; the length of each
value is kept beside it, so every column can be taken apart again.  Blocks are
the unit of the shuffle: they have a bounded number of bytes, so no task
gathers more than a block's worth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsync.functions.ragged import to_binary

#: Values that a task takes out of a column before it passes them on.
PASSED_ON = 1 << 16
#: Names of the columns that every event has, in wire order, and the bytes of each.
HEADER_COLUMNS = {"BodyLens": (1, 3), "SeqNums": (4, 1), "Flags1": (5, 1), "Timestamps": (6, 4), "EventTypes": (10, 1), "ServerIds": (11, 4), "EventLens": (15, 4), "NextPoses": (19, 4), "Flags": (23, 2)}
#: Columns with the whole body of a kind.
WHOLE_COLUMNS = {"FORMAT_DESCRIPTION": "Formats", "TRANSACTION_PAYLOAD": "Trans", "PREVIOUS_GTIDS": "Prevs", "ANONYMOUS_GTID": "Anons", "ROTATE": "Rotates", "QUERY": "Querys", "XID": "Xids", "STOP": "Stops"}
#: Columns of table maps and of rows.
TABLE_COLUMNS = ("TableIds", "NoUseds", "DbNameLens", "DbNames", "TableInfos")
ROW_COLUMNS = ("TableIds2", "Reserveds", "ExtraInfoLens", "ExtraInfos", "ColumnNums", "IncludedColumns", "NullColumns", "CheckSums")


def column_key(table_id: Column, column_id: Column) -> Column:
    """The name of a user column: ``table:column``."""
    return F.concat_ws(":", table_id.cast("string"), column_id.cast("string"))


def split_key(name: Column) -> Column:
    """``table_id, column_id`` of a user column's name; null for other names."""
    parts = F.split(name, ":")
    return F.when(name.rlike("^[0-9]+:[0-9]+$"), F.struct(parts[0].cast("long").alias("table_id"), parts[1].cast("int").alias("column_id")))


def unpivot(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """One row for each value: ``*keys, column_name, value``; null values are left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), c.cast("binary").alias("value")) for n, c in columns.items()])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.column_name", "_p.value").where("value IS NOT NULL")


def transpose(values: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Columns of each block: ``*keys, column_name, n_values, ori_len, values, lens, places``."""
    # lengths beside the bytes, in the same order, so that no value is held twice
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), F.octet_length("value").alias("len"))))
    joined = F.expr(f"listagg(value) WITHIN GROUP (ORDER BY {order}, octet_length(value))")
    grouped = values.groupBy(*keys, "column_name").agg(F.count("*").alias("n_values"), F.sum(F.octet_length("value")).cast("long").alias("ori_len"), held.alias("_h"), joined.alias("values"))
    return grouped.select(*keys, "column_name", "n_values", "ori_len", "values", F.col("_h.len").alias("lens"), F.col("_h.place").alias("places"))


def untranspose(columns: DataFrame, keys: list[str]) -> DataFrame:
    """The values again: ``*keys, column_name, place, value``.

    A column's values are its bytes with other bounds, so they are taken apart as
    arrays, ``PASSED_ON`` values at a time, and none carries its column's bytes along.
    """
    held = columns.select(*keys, "column_name", "places", "lens", "values")
    n = len(keys) + 1
    place = held.schema["places"].dataType.elementType.simpleString()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:n]), f"place {place}", "value binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                places, lens = batch.column(n)[row].values, batch.column(n + 1)[row].values.to_numpy()
                data = np.frombuffer(batch.column(n + 2)[row].as_buffer(), np.uint8)
                ends = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
                for lo in range(0, len(lens), PASSED_ON):
                    hi = min(lo + PASSED_ON, len(lens))
                    same = pa.array(np.full(hi - lo, row))
                    value = to_binary(data[ends[lo] : ends[hi]], lens[lo:hi])
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(same) for k in range(n)), places.slice(lo, hi - lo), value], names=[*keys, "column_name", "place", "value"])

    return held.mapInArrow(run, schema)


def check_counts(columns: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The columns, or an error where a block's event count is not that of its packets."""
    seen = columns.where(F.col("column_name") == "BodyLens").select(*keys, F.col("n_values").alias("_n"))
    joined = columns.join(blocks.select(*keys, "n_events").join(seen, keys, "left"), keys, "left")
    return joined.withColumn("n_values", F.when(F.col("n_events").eqNullSafe(F.col("_n")), F.col("n_values")).otherwise(F.raise_error(F.lit("a block has lost events")))).drop("n_events", "_n")


def column_sizes(values: DataFrame, keys: list[str]) -> DataFrame:
    """Values and bytes of each column of each block."""
    return values.groupBy(*keys, "column_name").agg(F.count("*").alias("n_values"), F.sum("size").cast("long").alias("ori_len"))


def cursors(plan: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Byte ranges of consecutive takes of a column: ``lo`` and ``hi``, cut at the column's ``ori_len``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("byte_num").over(w)
    return plan.withColumn("_hi", end).withColumn("lo", F.least(F.col("_hi") - F.col("byte_num"), F.col("ori_len"))).withColumn("hi", F.least("_hi", "ori_len")).drop("_hi")


def take(values: Column, lo: Column, hi: Column) -> Column:
    """The bytes of a column from ``lo`` to ``hi``."""
    return F.substring(values, (lo + 1).cast("int"), (hi - lo).cast("int"))


def event_values(events: DataFrame, images: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every value of every column: ``file, packet_no, *keep, column_name, value``.

    ``events`` are ``headers(packets)`` with the packets' bodies.  Row images,
    if given, add the user columns, named by ``column_key``.  ``keep`` are columns
    of both to carry along, such as the block of a packet: a packet is one row, its
    values are some thirty, so what is to be joined is joined before.
    """
    from colsync.functions.binary import to_little_endian
    from colsync.operators.events import view
    from colsync.sources.binlog import EVENTS

    keys = ["file", "packet_no", *keep]
    head = {"BodyLens": to_little_endian("body_len", 3), "SeqNums": to_little_endian("seq", 1), "Flags1": to_little_endian("flag", 1)}
    head |= {n: F.expr(f"substring(body, {at - 5}, {size})") for n, (at, size) in HEADER_COLUMNS.items() if at > 5}
    head |= {name: F.when(F.col("event_type") == EVENTS[kind], F.col("data")) for kind, name in WHOLE_COLUMNS.items()}
    out = unpivot(events.where("event_type IS NOT NULL"), keys, head)
    maps, rows = view(events, "TABLE_MAP", keep), view(events, "WRITE_ROWS", keep)
    part = lambda at, size: F.expr(f"substring(data, {at}, {size})")
    out = out.unionByName(unpivot(maps, keys, dict(zip(TABLE_COLUMNS, (part(1, 6), F.col("unused"), part(9, 1), F.col("db"), F.col("table_info")), strict=True))))
    fields = (part(1, 6), F.col("reserved"), part(9, 2), F.col("extra"), to_little_endian("n_columns", 1), F.col("included"), F.col("nulls"), F.col("checksum"))
    out = out.unionByName(unpivot(rows, keys, dict(zip(ROW_COLUMNS, fields, strict=True))))
    if images is not None:
        each = images.select(*keys, "table_id", F.posexplode("values").alias("column_id", "value")).where("value IS NOT NULL")
        out = out.unionByName(each.select(*keys, column_key(F.col("table_id"), F.col("column_id")).alias("column_name"), "value"))
    return out
