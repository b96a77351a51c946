"""Tables as packet streams: what the queries and tests read back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsync.functions.mysql import TYPES, TableInfo, table_map_body
from colsync.operators import blocks, events, rows
from colsync.operators.codecs import POOL
from colsync.sources.binlog import EVENTS, event_packets


#: Ranges in which the packets of a file are numbered.
RANGES = 64


@dataclass(frozen=True)
class Log:
    """How a table is logged: its id, definition and column names."""

    table_id: int
    info: TableInfo
    columns: tuple[str, ...]


def _log(table_id: int, name: str, fields: dict[str, str]) -> Log:
    meta = {"DOUBLE": 8, "VARCHAR": 200, "DATETIME2": 6}
    info = TableInfo("colsync", name, tuple(TYPES[t] for t in fields.values()), tuple(meta.get(t, 0) for t in fields.values()), (True,) * len(fields))
    return Log(table_id, info, tuple(fields))


ORDERS = _log(101, "orders", {"o_orderkey": "LONGLONG", "o_custkey": "LONGLONG", "o_orderstatus": "VARCHAR", "o_totalprice": "DOUBLE", "o_orderdate": "DATETIME2", "o_orderpriority": "VARCHAR"})
LINEITEM = _log(102, "lineitem", {
    "l_orderkey": "LONGLONG", "l_partkey": "LONGLONG", "l_suppkey": "LONGLONG", "l_linenumber": "LONG", "l_quantity": "DOUBLE", "l_extendedprice": "DOUBLE", "l_discount": "DOUBLE",
    "l_tax": "DOUBLE", "l_returnflag": "VARCHAR", "l_linestatus": "VARCHAR", "l_shipdate": "DATETIME2",
})


def table_packets(table: DataFrame, log: Log, file: Column, order: list[str]) -> DataFrame:
    """A TABLE_MAP at the head of each file, then a WRITE_ROWS packet for each row, in order; files are numbered in ranges of the first column of the order."""
    keyed = blocks.parted(table, order, RANGES).withColumnRenamed("_part", "_range").withColumn("_file", file.cast("string")).withColumn("_order", F.struct(*order))
    images = rows.encode_images(keyed, log.info, list(log.columns), keep=("_range", "_file", "_order"))
    from colsync.functions.binary import to_little_endian

    n, k = len(log.columns), (len(log.columns) + 7) // 8
    included = bytes((1 << min(8, n - 8 * i)) - 1 for i in range(k)).hex()
    lit = lambda h: F.unhex(F.lit(h))
    head = F.concat(to_little_endian(F.lit(log.table_id), 6), lit("0000"), lit("0200"), to_little_endian(F.lit(n), 1), lit(included))
    body = F.concat(head, F.col("nulls"), F.col("image"), lit("00000000"))
    data = images.select("_file", "_range", F.lit(1).alias("_part"), "_order", F.lit(EVENTS["WRITE_ROWS"]).alias("_kind"), body.alias("_body"))
    first = F.lit(None).cast(dict(data.dtypes)["_order"])
    maps = keyed.select("_file").distinct().select("_file", F.lit(-1).alias("_range"), F.lit(0).alias("_part"), first.alias("_order"), F.lit(EVENTS["TABLE_MAP"]).alias("_kind"), lit(table_map_body(log.table_id, log.info).hex()).alias("_body"))
    return event_packets(maps.unionByName(data), F.col("_kind"), F.col("_body"), F.lit(1_700_000_000), "_file", [F.col("_part"), F.col("_order")], "_range")


def decoded(packets: DataFrame, log: Log) -> DataFrame:
    """The table again, typed, with the file and number of each packet."""
    heads = events.headers(packets)
    images = rows.row_images(events.view(heads, "WRITE_ROWS").where(F.col("table_id") == log.table_id), {log.table_id: log.info})
    return rows.typed_rows(images, log.info, list(log.columns), keep=("file", "packet_no"))


def literal_profile(spark: SparkSession) -> DataFrame:
    """Gains and speeds by rule, for plans that have to come out the same everywhere: ``codec, gain, bw``."""
    return spark.createDataFrame([(c, *profile_of(c)) for c in POOL], "codec int, gain double, bw double")


def profile_of(codec: int) -> tuple[float, float]:
    """Gain and speed of the rule: the more a codec gains, the slower it is."""
    step = codec - 151
    return (1.0, 1e12) if step == 0 else (1.25 + 0.25 * step, 4e8 / (1 << step))
