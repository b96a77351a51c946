"""Event headers and bodies as columns, one view for each kind.

All views are projections of a packet's body by built-in functions.  A packet
that is not an event, with a flag other than 0 or under 20 bytes, and an event
of a kind without a view stay available as they are (``raw``); ``fail_fast``
raises on them instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsync.functions.binary import byte_at, little_endian
from colsync.sources.binlog import EVENTS, NAMES

HEADER = 19
#: Bytes of a packet's body, with its flag, that an event has at least.
LEAST = 20


def is_event() -> Column:
    """Whether a packet holds an event."""
    return (F.col("flag") == 0) & (F.col("body_len") >= LEAST)


def headers(packets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Packets with ``ts, event_type, server_id, event_len, next_pos, flags`` and the event ``data``; null for what is no event; ``keep`` are columns to carry along."""
    field = lambda at, size, kind: F.when(is_event(), little_endian("body", at, size).cast(kind))
    return packets.select(
        "file", "packet_no", "offset", "body_len", "seq", "flag",
        field(1, 4, "long").alias("ts"), field(5, 1, "int").alias("event_type"), field(6, 4, "long").alias("server_id"), field(10, 4, "long").alias("event_len"),
        field(14, 4, "long").alias("next_pos"), field(18, 2, "int").alias("flags"), F.when(is_event(), F.expr(f"substring(body, {HEADER + 1})")).alias("data"), "body", *keep,
    )


def _piece(at, size) -> Column:
    at, size = (x.cast("int") if isinstance(x, Column) else F.lit(x) for x in (at, size))
    return F.substring(F.col("data"), at, size)


def _rest(at) -> Column:
    at = at.cast("int") if isinstance(at, Column) else F.lit(at)
    return F.substring(F.col("data"), at, F.lit(2**31 - 1))


def _query() -> dict[str, Column]:
    status, db = little_endian("data", 12, 2), byte_at("data", 9)
    return {
        "thread_id": little_endian("data", 1, 4), "exec_time": little_endian("data", 5, 4), "db_len": db, "error_code": little_endian("data", 10, 2), "status_len": status,
        "status_vars": _piece(14, status), "db": _piece(14 + status, db).cast("string"), "sql": _rest(14 + status + db),
    }


def _table_map() -> dict[str, Column]:
    size = byte_at("data", 9)
    return {"table_id": little_endian("data", 1, 6), "unused": _piece(7, 2), "db_len": size, "db": _piece(10, size).cast("string"), "table_info": _rest(10 + size)}


def _write_rows() -> dict[str, Column]:
    extra = little_endian("data", 9, 2)
    n = byte_at("data", (9 + extra).cast("int"))
    k = F.floor((n + 7) / 8)
    return {
        "table_id": little_endian("data", 1, 6), "reserved": _piece(7, 2), "extra_len": extra, "extra": _piece(11, extra - 2), "n_columns": n,
        "included": _piece(10 + extra, k), "nulls": _piece(10 + extra + k, k), "image": F.substring(F.col("data"), (10 + extra + 2 * k).cast("int"), (F.octet_length("data") - (9 + extra + 2 * k) - 4).cast("int")),
        "checksum": _piece(F.octet_length("data") - 3, 4),
    }


#: What each kind's view has beside the header.
VIEWS: dict[str, Callable[[], dict[str, Column]]] = {
    "FORMAT_DESCRIPTION": lambda: {"version": little_endian("data", 1, 2), "server_version": F.regexp_replace(_piece(3, 50).cast("string"), "\\x00+$", ""), "created": little_endian("data", 53, 4), "header_len": byte_at("data", 57)},
    "TRANSACTION_PAYLOAD": lambda: {"payload": F.col("data")},
    "PREVIOUS_GTIDS": lambda: {"gtid_flags": _piece(1, 1), "gtids": _rest(2)},
    "ANONYMOUS_GTID": lambda: {"gtid": F.col("data")},
    "ROTATE": lambda: {"position": little_endian("data", 1, 8), "next_name": _rest(9)},
    "QUERY": _query,
    "TABLE_MAP": _table_map,
    "WRITE_ROWS": _write_rows,
    "XID": lambda: {"xid": little_endian("data", 1, 8)},
    "STOP": lambda: {},
}
HANDLED = tuple(EVENTS[k] for k in VIEWS)


def view(events: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The events of one kind with its fields; ``events`` are ``headers(packets, keep)``."""
    fields = VIEWS[kind]()
    return events.where(F.col("event_type") == EVENTS[kind]).select("file", "packet_no", *keep, "ts", "server_id", "data", *[c.alias(n) for n, c in fields.items()])


def raw(events: DataFrame, fail_fast: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """What no view covers: other packets, and events of other kinds."""
    other = F.col("event_type").isNull() | ~F.col("event_type").isin(*HANDLED)
    rows = events.where(other).select("file", "packet_no", *keep, "flag", "event_type", "body")
    if not fail_fast:
        return rows
    said = F.concat(F.lit("no view for event type "), F.coalesce(F.col("event_type").cast("string"), F.lit("none")))
    return rows.withColumn("body", F.raise_error(said).cast("binary"))


def event_counts(events: DataFrame) -> DataFrame:
    """Events and bytes by kind: ``event_type, event_name, n_events, n_bytes``."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    counted = events.groupBy("event_type").agg(F.count("*").alias("n_events"), F.sum(F.col("body_len") + 4).cast("long").alias("n_bytes"))
    return counted.select("event_type", F.coalesce(names[F.col("event_type")], F.lit("OTHER")).alias("event_name"), "n_events", "n_bytes")


def packet_text() -> Column:
    """A packet in one line."""
    return F.format_string("packet %d of %s: %d bytes, sequence %d, flag %d", "packet_no", "file", "body_len", "seq", "flag")
