"""The engine's registered queries and their DuckDB counterparts.

Every query runs over whole tables.  Results are integers, texts or rounded
numbers, and all that depends on a clock is replaced by the literal profile of
``logs``, so that both engines can be compared by value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colsync.functions import binary as fb
from colsync.functions import mysql
from colsync.functions.ragged import to_binary
from colsync.operators import blocks, codecs, columns, container, events, lightweight, rows, stats, transport
from colsync.plans import logs, pipeline, planner, profile
from colsync.plans.tables import Tables, new_folder
from colsync.sources import binlog
from colsync.sources import packages as wire
from colsync.sources.manifest import Manifest
from colsync.sources.store import sized_files
from colsync.streaming import loop, state

QUERIES: dict = {}
ORACLES: dict = {}

BANDWIDTH = 2e6
#: Bytes of a fixed block and of a greedy block in the queries.
FIXED_BYTES, BOUND_BYTES = 65_536, 4_000


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Epoch seconds of a timestamp without zone, read as UTC."""
    return F.unix_seconds(F.col(column).cast("timestamp"))


# -- packets and events ---------------------------------------------------------

ORDER_BYTES = "24 + 13 + 4 + 8 + 8 + (1 + strlen(o_orderstatus)) + 8 + 8 + (1 + strlen(o_orderpriority))"
ORDER_MAP_BYTES = 24 + len(mysql.table_map_body(logs.ORDERS.table_id, logs.ORDERS.info))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a packet stream: events and bytes by block and kind."""
    packets = logs.table_packets(table(spark, sf_dir, "orders"), logs.ORDERS, F.col("o_orderpriority"), ["o_orderkey"])
    cut = blocks.bound_blocks(pipeline.index(packets), FIXED_BYTES).select("file", "packet_no", "block_no")
    heads = events.headers(packets).select("file", "packet_no", "event_type", "body_len")
    return heads.join(cut, ["file", "packet_no"]).groupBy("file", "block_no", "event_type").agg(F.count("*").alias("n_events"), F.sum(F.col("body_len") + 4).cast("long").alias("n_bytes"))


@query(f"""
    SELECT 19 AS event_type, 'TABLE_MAP' AS event_name, count(DISTINCT o_orderpriority) AS n_events, (count(DISTINCT o_orderpriority) * {ORDER_MAP_BYTES})::BIGINT AS n_bytes FROM orders
    UNION ALL SELECT 30, 'WRITE_ROWS', count(*), sum({ORDER_BYTES})::BIGINT FROM orders""")
def event_type_counts(spark, sf_dir):
    """Orders as a packet stream, its headers decoded, events and bytes by kind."""
    packets = logs.table_packets(table(spark, sf_dir, "orders"), logs.ORDERS, F.col("o_orderpriority"), ["o_orderkey"])
    return events.event_counts(events.headers(packets))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS order_us, o_orderpriority FROM orders""")
def binlog_roundtrip(spark, sf_dir):
    """Orders encoded as row images in packets and decoded to typed columns again."""
    packets = logs.table_packets(table(spark, sf_dir, "orders"), logs.ORDERS, F.col("o_orderpriority"), ["o_orderkey"])
    back = logs.decoded(packets, logs.ORDERS)
    return back.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("order_us"), "o_orderpriority")


def _written(spark, sf_dir) -> str:
    """Orders as logs in a new folder."""
    folder = new_folder(spark, "logs")
    binlog.write_log(logs.table_packets(table(spark, sf_dir, "orders"), logs.ORDERS, F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "_"), ["o_orderkey"]), f"{folder}/in")
    return folder


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS order_us, o_orderpriority, regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g') AS file FROM orders""")
def binlog_source(spark, sf_dir):
    """Orders written as binlog files, read by the source in parts of 256 KiB, the table definition from its event, and decoded."""
    packets = binlog.read_packets(spark, f"{_written(spark, sf_dir)}/in", split_bytes=256 << 10)
    heads = events.headers(packets)
    maps = events.view(heads, "TABLE_MAP")
    [info] = rows.registry_of(maps.where(F.col("table_id") == logs.ORDERS.table_id)).values()
    back = rows.typed_rows(rows.row_images(events.view(heads, "WRITE_ROWS"), rows.definitions_of(maps)), info, list(logs.ORDERS.columns), keep=("file",))
    return back.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("order_us"), "o_orderpriority", "file")


@query(f"""
    SELECT 'TABLE_MAP' AS event_name, count(DISTINCT o_orderpriority) AS n_events, (count(DISTINCT o_orderpriority) * {ORDER_MAP_BYTES})::BIGINT AS n_bytes FROM orders
    UNION ALL SELECT 'WRITE_ROWS', count(*), sum({ORDER_BYTES})::BIGINT FROM orders""")
def binlog_stream(spark, sf_dir):
    """The same files as a stream into the sink, some units of the manifest a trigger, twice over from one checkpoint; what it holds is counted, and nothing came twice."""
    folder = _written(spark, sf_dir)
    size = sum(n for _, n in sized_files(f"{folder}/in"))
    log = Manifest(spark, f"{folder}/in", f"{folder}/manifest", split_bytes=max(64 << 10, size // 16), unit_bytes=max(64 << 10, size // 4))
    for _ in range(2):
        log.refresh()
        state.package_sink(log.stream(units_per_trigger=2), f"{folder}/out", f"{folder}/checkpoint", 600)
    return events.event_counts(events.headers(spark.read.parquet(f"{folder}/out"))).drop("event_type")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, min(epoch_us(l_shipdate)) AS first_us, max(l_partkey) AS last_part FROM lineitem GROUP BY ALL""")
def lineitem_log_summary(spark, sf_dir):
    """Lineitem through row images of fixed and variable width, summed."""
    t = table(spark, sf_dir, "lineitem")
    images = rows.encode_images(t, logs.LINEITEM.info, list(logs.LINEITEM.columns))
    n = len(logs.LINEITEM.columns)
    head = F.concat(fb.to_little_endian(F.lit(logs.LINEITEM.table_id), 6), F.unhex(F.lit("00000200")), fb.to_little_endian(F.lit(n), 1), F.unhex(F.lit("ff07")))
    data = images.select(F.lit("lineitem").alias("file"), F.monotonically_increasing_id().alias("packet_no"), F.lit(logs.LINEITEM.table_id).cast("long").alias("table_id"), F.concat(head, "nulls", "image", F.unhex(F.lit("00000000"))).alias("data"))
    back = rows.typed_rows(rows.row_images(data, {logs.LINEITEM.table_id: logs.LINEITEM.info}), logs.LINEITEM.info, list(logs.LINEITEM.columns))
    return back.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.min(F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("first_us"), F.max("l_partkey").alias("last_part"))


_BY_TURN = (*events.HANDLED, 99)


@query(f"""
    SELECT k.code AS event_type, k.name AS event_name, count(*) AS n_events, sum(24 + strlen(props))::BIGINT AS n_bytes
    FROM events JOIN (VALUES {", ".join(f"({i}, {c}, '{events.NAMES.get(c, 'OTHER')}')" for i, c in enumerate(_BY_TURN))}) AS k(turn, code, name) ON event_id % {len(_BY_TURN)} = turn GROUP BY k.code, k.name""")
def events_by_kind(spark, sf_dir):
    """Events as packets of all kinds in turn, one of them unknown, a file for each user; counted from the decoded headers."""
    e = table(spark, sf_dir, "events").withColumn("_file", F.col("user_id").cast("string"))
    kind = F.element_at(F.array(*[F.lit(c) for c in _BY_TURN]), (F.col("event_id") % len(_BY_TURN) + 1).cast("int"))
    return events.event_counts(events.headers(binlog.event_packets(e, kind, F.col("props").cast("binary"), F.lit(0), "_file", [F.col("event_id")])))


# -- blocks ---------------------------------------------------------------------

_DOC_PACKETS = """SELECT source AS file, doc_id, 24 + strlen(coalesce(text, '')) AS packet_len,
    coalesce(sum(24 + strlen(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM documents"""


def _document_packets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("_n"))
    return blocks.packet_offsets(docs, F.col("_n") + 24, ["file"], ["doc_id"]).drop("_n")


@query(_DOC_PACKETS.replace("24 + strlen(coalesce(text, '')) AS packet_len", "(24 + strlen(coalesce(text, '')))::BIGINT AS packet_len"))
def packet_offsets(spark, sf_dir):
    """Offsets of documents as packets, a file for each source."""
    return _document_packets(spark, sf_dir)


@query(f"""
    WITH p AS ({_DOC_PACKETS}),
    b AS (SELECT file, "offset" AS o, packet_len AS n, unnest(generate_series("offset" // {FIXED_BYTES}, ("offset" + packet_len - 1) // {FIXED_BYTES})) AS block_no FROM p)
    SELECT file, block_no, count(*) AS n_packets, sum(least(o + n, (block_no + 1) * {FIXED_BYTES}) - greatest(o, block_no * {FIXED_BYTES}))::BIGINT AS ori_len FROM b GROUP BY ALL""")
def fixed_blocks(spark, sf_dir):
    """Blocks of one size over the documents' packets."""
    return blocks.fixed_blocks(_document_packets(spark, sf_dir), FIXED_BYTES, ["file"])


_EVENT_PACKETS = """SELECT (user_id % 16)::VARCHAR AS file, (row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) - 1) AS packet_no, (24 + strlen(props))::BIGINT AS packet_len,
    (event_id % 97 <> 0) AS class, event_type FROM events"""


def _event_packets(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("file", (F.col("user_id") % 16).cast("string"))
    w = Window.partitionBy("file").orderBy("event_id")
    e = e.select("file", "event_id", (F.row_number().over(w) - 1).cast("long").alias("packet_no"), F.octet_length("props").alias("_n"), (F.col("event_id") % 97 != 0).alias("class"), "event_type")
    return blocks.packet_offsets(e, F.col("_n") + 24, ["file"], ["event_id"]).select("file", "packet_no", "offset", "packet_len", "class", "event_type")


_BOUND = f"""
    WITH RECURSIVE p AS ({_EVENT_PACKETS}),
    q AS (SELECT *, sum(packet_len) OVER (PARTITION BY file ORDER BY packet_no) - packet_len AS o, count_if(changed) OVER (PARTITION BY file ORDER BY packet_no) AS island
          FROM (SELECT *, class IS DISTINCT FROM lag(class) OVER (PARTITION BY file ORDER BY packet_no) AS changed FROM p)),
    cut AS (
        SELECT file, 0 AS block_no, packet_no AS s, o, island FROM q WHERE packet_no = 0
        UNION ALL
        SELECT c.file, c.block_no + 1, n.packet_no, n.o, n.island FROM cut c, LATERAL (
            SELECT packet_no, o, island FROM q WHERE q.file = c.file AND q.packet_no > c.s AND (q.o > c.o + {BOUND_BYTES} OR q.island <> c.island) ORDER BY packet_no LIMIT 1) n),
    ranged AS (SELECT *, lead(s) OVER (PARTITION BY file ORDER BY block_no) AS e FROM cut)"""


@query(
    _BOUND
    + """
    SELECT r.file, r.block_no::BIGINT AS block_no, min(packet_no) AS first_packet, count(*) AS n_events, sum(packet_len)::BIGINT AS ori_len, bool_or(class) AS class, (r.block_no * 10)::BIGINT AS cut_ms
    FROM ranged r JOIN q ON q.file = r.file AND q.packet_no >= r.s AND (r.e IS NULL OR q.packet_no < r.e) GROUP BY r.file, r.block_no"""
)
def bound_blocks(spark, sf_dir):
    """Greedy blocks that end at packets and where the class changes."""
    return blocks.block_summary(blocks.bound_blocks(_event_packets(spark, sf_dir), BOUND_BYTES), 0, 10)


@query(ORACLES["bound_blocks"])
def stream_blocks(spark, sf_dir):
    """The same blocks from a stream of the packets, a part of every file a trigger; the open block goes on in the next one."""
    state.use_rocksdb(spark)
    folder = new_folder(spark, "logs")
    index = _event_packets(spark, sf_dir).select("file", "packet_no", "offset", "packet_len", "class")
    index.repartitionByRange(6, "packet_no").write.parquet(f"{folder}/index")
    packets = spark.readStream.schema(index.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/index")
    state.package_sink(state.block_stream(packets, BOUND_BYTES), f"{folder}/cut", f"{folder}/checkpoint", 600)
    return blocks.block_summary(spark.read.parquet(f"{folder}/cut"), 0, 10)


@query(f"""
    SELECT file, island::BIGINT AS island, bool_or(class) AS class, count(*) AS n_packets
    FROM (SELECT file, class, count_if(changed) OVER (PARTITION BY file ORDER BY packet_no) AS island
          FROM (SELECT *, class IS DISTINCT FROM lag(class) OVER (PARTITION BY file ORDER BY packet_no) AS changed FROM ({_EVENT_PACKETS}))) GROUP BY file, island""")
def class_split(spark, sf_dir):
    """Stretches of packets of one class."""
    return blocks.class_islands(_event_packets(spark, sf_dir), F.col("class"), ["file"], ["packet_no"]).withColumn("island", F.col("island").cast("long"))


@query(
    _BOUND
    + """
    SELECT r.file, r.block_no::BIGINT AS block_no, event_type, count(*) AS n
    FROM ranged r JOIN q ON q.file = r.file AND q.packet_no >= r.s AND (r.e IS NULL OR q.packet_no < r.e) GROUP BY r.file, r.block_no, event_type"""
)
def block_event_counts(spark, sf_dir):
    """Events of each kind in each greedy block."""
    packets = _event_packets(spark, sf_dir)
    held = blocks.bound_blocks(packets, BOUND_BYTES).select("file", "packet_no", "block_no")
    return held.join(packets.select("file", "packet_no", "event_type"), ["file", "packet_no"]).groupBy("file", "block_no", "event_type").agg(F.count("*").alias("n"))


# -- columns --------------------------------------------------------------------

_LINE_COLUMNS = {"l_orderkey": "8", "l_partkey": "8", "l_linenumber": "4", "l_quantity": "8", "l_returnflag": "1 + strlen(l_returnflag)", "l_linestatus": "1 + strlen(l_linestatus)", "l_shipdate": "8"}


def _line_sizes(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumn("block_no", F.floor(F.col("l_orderkey") / 200))
    size = {n: F.lit(int(s)) if s.isdigit() else F.octet_length(n) + 1 for n, s in _LINE_COLUMNS.items()}
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), s.alias("size")) for n, s in size.items()])
    return columns.column_sizes(t.select("block_no", F.explode(pairs).alias("_p")).select("block_no", "_p.*"), ["block_no"])


_SIZES = " UNION ALL ".join(f"SELECT l_orderkey // 200 AS block_no, '{n}' AS column_name, count(*) AS n_values, sum({s})::BIGINT AS ori_len FROM lineitem GROUP BY 1" for n, s in _LINE_COLUMNS.items())


@query(_SIZES)
def column_sizes(spark, sf_dir):
    """Values and bytes of each column of each block."""
    return _line_sizes(spark, sf_dir)


@query(f"""
    WITH c AS ({_SIZES}), t AS (SELECT *, unnest(range(ceil(ori_len / 1000)::BIGINT + 1)) AS turn FROM c),
    w AS (SELECT *, sum(1000) OVER (PARTITION BY block_no, column_name ORDER BY turn) AS e FROM t)
    SELECT block_no, column_name, turn, least(e - 1000, ori_len)::BIGINT AS lo, least(e, ori_len)::BIGINT AS hi FROM w""")
def column_slices(spark, sf_dir):
    """Takes of 1000 bytes from each column until it is empty, and one more."""
    takes = _line_sizes(spark, sf_dir).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("ori_len") / 1000)))).withColumn("byte_num", F.lit(1000))
    return columns.cursors(takes, ["block_no", "column_name"], ["turn"]).select("block_no", "column_name", "turn", "lo", "hi")


@query("""SELECT o_orderkey, o_orderstatus, o_custkey FROM orders""")
def transpose_roundtrip(spark, sf_dir):
    """Orders as columns of bytes by block and as rows again."""
    o = table(spark, sf_dir, "orders").withColumn("block_no", F.floor(F.col("o_orderkey") / 512))
    values = columns.unpivot(o, ["block_no", "o_orderkey"], {"custkey": fb.to_little_endian("o_custkey", 8), "status": F.col("o_orderstatus")})
    back = columns.untranspose(columns.transpose(values, ["block_no"], "o_orderkey"), ["block_no"])
    wide = back.groupBy("place").agg(F.max(F.when(F.col("column_name") == "custkey", F.col("value"))).alias("c"), F.max(F.when(F.col("column_name") == "status", F.col("value"))).alias("s"))
    return wide.select(F.col("place").alias("o_orderkey"), F.col("s").cast("string").alias("o_orderstatus"), fb.little_endian("c", 1, 8).cast("long").alias("o_custkey"))


# -- lightweight codecs ---------------------------------------------------------


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("block_no", F.floor(F.col("o_orderkey") / 1000))


_RUNS = """SELECT block_no, run_no, any_value(v) AS run_value, count(*) AS run_length FROM (
    SELECT *, sum(s) OVER (PARTITION BY block_no ORDER BY o_orderkey)::BIGINT AS run_no FROM (
        SELECT o_orderkey // 1000 AS block_no, o_orderkey, o_orderstatus AS v, CASE WHEN o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER w AND lag(o_orderkey) OVER w IS NOT NULL THEN 0 ELSE 1 END AS s
        FROM orders WINDOW w AS (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey))) GROUP BY block_no, run_no"""


@query(_RUNS)
def rle_runs(spark, sf_dir):
    """Runs of order states."""
    return lightweight.rle_runs(_orders(spark, sf_dir), "o_orderstatus", ["block_no"], ["o_orderkey"])


@query(f"SELECT block_no, count(*) AS n_runs, sum(run_length)::BIGINT AS n_values, (4 + count(*) * 5)::BIGINT AS encoded_bytes FROM ({_RUNS}) GROUP BY block_no")
def rle_size(spark, sf_dir):
    """Encoded bytes of the runs."""
    return lightweight.rle_size(rle_runs(spark, sf_dir), 1, ["block_no"])


@query("""SELECT o_orderkey // 1000 AS block_no, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) - 1 AS position, o_orderstatus AS value FROM orders""")
def rle_roundtrip(spark, sf_dir):
    """Runs expanded to values again."""
    return lightweight.rle_expand(rle_runs(spark, sf_dir), ["block_no"])


_W = "WINDOW w AS (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey)"


@query(f"SELECT o_orderkey, coalesce((o_custkey - lag(o_custkey) OVER w + 4294967296) % 4294967296, o_custkey) AS delta FROM orders {_W}")
def delta_values(spark, sf_dir):
    """Wrapped differences of customers."""
    return lightweight.delta_values(_orders(spark, sf_dir), "o_custkey", ["block_no"], ["o_orderkey"]).select("o_orderkey", "delta")


@query("SELECT o_orderkey, o_custkey AS value FROM orders")
def delta_roundtrip(spark, sf_dir):
    """Values from their differences again."""
    return lightweight.delta_undo(lightweight.delta_values(_orders(spark, sf_dir), "o_custkey", ["block_no"], ["o_orderkey"]), ["block_no"], ["o_orderkey"]).select("o_orderkey", "value")


_VARINT = "CASE " + " ".join(f"WHEN {{0}} < {1 << (7 * n)} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"


@query(f"""
    SELECT block_no, count(*) AS n_values, sum(CASE WHEN d IS NULL THEN 4 ELSE {_VARINT.format("(d * 2)")} END)::BIGINT AS encoded_bytes
    FROM (SELECT o_orderkey // 1000 AS block_no, (o_custkey - lag(o_custkey) OVER w + 4294967296) % 4294967296 AS d FROM orders {_W}) GROUP BY block_no""")
def delta_varint_size(spark, sf_dir):
    """Encoded bytes of the differences."""
    return lightweight.delta_size(_orders(spark, sf_dir), "o_custkey", ["block_no"], ["o_orderkey"])


_DOD = """SELECT user_id, event_id, d AS delta, d - lag(d) OVER (PARTITION BY user_id ORDER BY event_id) AS dod FROM (
    SELECT user_id, event_id, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events)"""


def _event_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", seconds("ts").alias("s"))


@query(f"SELECT user_id, event_id, delta, dod FROM ({_DOD})")
def dod_values(spark, sf_dir):
    """Differences and differences of differences of event times."""
    return lightweight.dod_values(_event_seconds(spark, sf_dir), "s", ["user_id"], ["event_id"]).select("user_id", "event_id", "delta", "dod")


_BITS = "CASE WHEN dod = 0 THEN 1 WHEN dod BETWEEN -63 AND 64 THEN 9 WHEN dod BETWEEN -255 AND 256 THEN 12 WHEN dod BETWEEN -2047 AND 2048 THEN 16 ELSE 36 END"


@query(f"SELECT {_BITS} AS bits, count(*) AS n FROM ({_DOD}) WHERE dod IS NOT NULL GROUP BY 1")
def dod_bits(spark, sf_dir):
    """How often each cost occurs."""
    rows_ = lightweight.dod_values(_event_seconds(spark, sf_dir), "s", ["user_id"], ["event_id"]).where("dod IS NOT NULL")
    return rows_.groupBy(fb.dod_bits("dod").alias("bits")).agg(F.count("*").alias("n"))


@query(f"""
    SELECT user_id, count(*) AS n_values, (32 * least(count(*), 2) + coalesce(sum(CASE WHEN dod IS NOT NULL THEN {_BITS} END), 0))::BIGINT AS bits,
           ((32 * least(count(*), 2) + coalesce(sum(CASE WHEN dod IS NOT NULL THEN {_BITS} END), 0)) // 8 + 1)::BIGINT AS encoded_bytes FROM ({_DOD}) GROUP BY user_id""")
def dod_size(spark, sf_dir):
    """Encoded bits and bytes of event times."""
    return lightweight.dod_size(_event_seconds(spark, sf_dir), "s", ["user_id"], ["event_id"])


@query(f"SELECT p_brand, count(*) AS n_values, sum({_VARINT.format('(p_partkey * p_size)')})::BIGINT AS encoded_bytes FROM part GROUP BY p_brand")
def varint_size(spark, sf_dir):
    """Varint bytes by brand."""
    return lightweight.varint_sizes(table(spark, sf_dir, "part").withColumn("v", F.col("p_partkey") * F.col("p_size")), "v", ["p_brand"])


@query("SELECT o_orderkey // 1000 AS block_no, count(*) AS n_values, true AS same FROM orders GROUP BY 1")
def byte_codec_roundtrip(spark, sf_dir):
    """Packed runs, differences, differences of differences and varints of each block, unpacked and compared."""
    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("o_orderkey")["o_custkey"].to_numpy()
        wide = v.astype("<u4").view(np.uint8).reshape(-1, 4)
        same = (lightweight.rle_decode(lightweight.rle_encode(wide), 4) == wide).all() and (lightweight.delta_decode(lightweight.delta_encode(v)) == v).all()
        same = same and (lightweight.dod_decode(lightweight.dod_encode(v), len(v)) == v).all() and (lightweight.varint_decode(lightweight.varint_encode(v)) == v).all()
        raw = wide.tobytes()
        return pd.DataFrame({"block_no": [pdf["block_no"].iloc[0]], "n_values": [len(v)], "same": [bool(same and lightweight.byte_rle_decode(lightweight.byte_rle_encode(raw)) == raw)]})

    return _orders(spark, sf_dir).select("block_no", "o_orderkey", "o_custkey").groupBy("block_no").applyInPandas(check, "block_no long, n_values long, same boolean")


# -- scalar functions -----------------------------------------------------------


def _texts(read, width: int):
    """A function of a column of values of one width: their bytes as rows of an array, read all at once as characters and lengths."""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        raw = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), width)
        return pd.Series(to_binary(*read(raw)).cast("string").to_pandas())

    return run


@query("""
    SELECT doc_id, (CASE WHEN quality IS NULL THEN 1 ELSE 0 END + CASE WHEN toxic = 1 THEN 2 ELSE 0 END + CASE WHEN quality = 1 THEN 4 ELSE 0 END)::INTEGER AS bitmap, coalesce(toxic = 1, false) AS second_bit, 1::BIGINT AS n_bytes
    FROM documents LEFT JOIN labels USING (doc_id)""")
def null_bitmap(spark, sf_dir):
    """A bitmap of three flags, packed and read again."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    packed = d.select("doc_id", fb.pack_bits([F.col("quality").isNull(), F.col("toxic") == 1, F.col("quality") == 1]).alias("b"))
    return packed.select("doc_id", fb.byte_at("b", F.lit(1)).alias("bitmap"), fb.is_bit_set("b", 1).alias("second_bit"), fb.bitmap_bytes(F.lit(3)).alias("n_bytes"))


@query("SELECT doc_id, bit_count(doc_id)::INTEGER AS bits, (doc_id >> 3) & 1 = 1 AS fourth FROM documents")
def bit_counts(spark, sf_dir):
    """Bits of ids, counted and taken from their bytes."""
    d = table(spark, sf_dir, "documents").select("doc_id", fb.to_little_endian("doc_id", 8).alias("b"))
    return d.select("doc_id", F.bit_count("doc_id").alias("bits"), fb.is_bit_set("b", 3).alias("fourth"))


@query("""
    SELECT doc_id, n AS value, CASE WHEN n < 251 THEN 1 WHEN n < 65536 THEN 3 WHEN n < 16777216 THEN 4 ELSE 9 END AS size, sha256(coalesce(text, '')) AS sha
    FROM (SELECT *, strlen(coalesce(text, '')) AS n FROM documents)""")
def lenenc_size(spark, sf_dir):
    """Lengths and whole texts, length-encoded and read again; the digest is that of the text read."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    n = F.octet_length("text")
    coded = d.select("doc_id", fb.to_length_encoded(n).alias("a"), n.alias("_n"), F.concat(fb.to_length_encoded(n), F.col("text")).alias("s"))
    read = fb.length_encoded_string("s", 1)
    return coded.select("doc_id", fb.length_encoded_int("a", 1)["value"].cast("long").alias("value"), fb.length_encoded_size("_n").alias("size"), F.sha2(read.cast("binary"), 256).alias("sha"))


@query("SELECT n_nationkey, (n_nationkey * 1000003)::BIGINT AS le6, (n_nationkey * 70001 % 16777216)::BIGINT AS le3, ((n_nationkey * 257) % 65536)::BIGINT AS be2 FROM nation")
def le_int_decode(spark, sf_dir):
    """Integers of 6, 3 and 2 bytes through their bytes."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("long")
    coded = n.select("n_nationkey", fb.to_little_endian(k * 1000003, 6).alias("a"), fb.to_little_endian(k * 70001, 3).alias("b"), fb.to_little_endian(k * 257, 2).alias("c"))
    swapped = F.concat(F.substring("c", 2, 1), F.substring("c", 1, 1))
    return coded.select("n_nationkey", fb.little_endian("a", 1, 6).alias("le6"), fb.little_endian("b", 1, 3).alias("le3"), fb.big_endian(swapped, 1, 2).alias("be2"))


@query("SELECT * FROM (VALUES ('800000.00', '00:00:00'), ('7FFFFF.FF', '-00:00:00.01'), ('7FFFFF.9D', '-00:00:00.99'), ('7FFFFF.00', '-00:00:01'), ('7FFFFE.FF', '-00:00:01.01'), ('7FFFFE.F6', '-00:00:01.10')) AS t(stored, text)")
def time2_decode(spark, sf_dir):
    """Stored times with two digits of a fraction as text."""
    stored = ["800000.00", "7FFFFF.FF", "7FFFFF.9D", "7FFFFF.00", "7FFFFE.FF", "7FFFFE.F6"]
    rows_ = spark.createDataFrame([(s,) for s in stored], "stored string")
    return rows_.select("stored", _texts(lambda raw: mysql.time2_texts(raw, 2), 4)(F.unhex(F.replace("stored", F.lit("."), F.lit("")))).alias("text"))


@query("""
    SELECT event_id, printf('%s%02d:%02d:%02d', CASE WHEN s > 0 AND event_id % 2 = 1 THEN '-' ELSE '' END, s // 3600, s // 60 % 60, s % 60) AS text
    FROM (SELECT event_id, floor(epoch(ts))::BIGINT % 3000000 AS s FROM events)""")
def time2_of_events(spark, sf_dir):
    """Times of up to 833 hours, below zero for every other event, stored without a fraction and read as text."""
    s = seconds("ts") % 3_000_000
    whole = F.shiftleft(F.floor(s / 3600), 12) + F.shiftleft(F.floor(s / 60) % 60, 6) + s % 60
    number = F.lit(1 << 23) + F.when(F.col("event_id") % 2 == 1, -whole).otherwise(whole)
    stored = F.unhex(F.lpad(F.hex(number), 6, "0"))
    return table(spark, sf_dir, "events").select("event_id", _texts(lambda raw: mysql.time2_texts(raw, 0), 3)(stored).alias("text"))


@query("SELECT o_orderkey, round(o_totalprice, 2)::DECIMAL(18, 2)::VARCHAR AS text FROM orders")
def decimal_decode(spark, sf_dir):
    """Prices packed as decimals and read as text again."""
    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return pd.Series([r.tobytes() for r in mysql.pack_decimals(values.fillna(0).to_numpy(np.int64), 18, 2)])

    unscaled = (F.round("o_totalprice", 2).cast("decimal(18,2)") * 100).cast("long")
    text = _texts(lambda raw: mysql.decimal_texts(raw, 18, 2), mysql.decimal_bytes(18, 2))(packed(unscaled))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice").isNotNull(), text).alias("text"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({c}, '{n}')" for c, n in mysql.TYPE_NAMES.items()) + ") AS t(code, name)")
def type_names(spark, sf_dir):
    """Names of the column types."""
    return spark.createDataFrame([(c, mysql.type_name(c)) for c in mysql.TYPE_NAMES], "code int, name string")


@query("SELECT * FROM (VALUES " + ", ".join(f"({c.id}, '{c.name}', {str(c.available).lower()})" for c in codecs.CODECS.values()) + ") AS t(codec, name, available)")
def codec_names(spark, sf_dir):
    """Names of the codecs by id."""
    rows_ = spark.createDataFrame([(c.id, c.available) for c in codecs.CODECS.values()], "codec int, available boolean")
    return rows_.select("codec", codecs.codec_name(F.col("codec")).alias("name"), "available")


# -- registry and profiles ------------------------------------------------------


@query("SELECT o_custkey % 50 AS table_id, arg_min(o_orderpriority, o_orderkey) AS name, (1 + o_custkey % 50 % 3)::INTEGER AS n_columns FROM orders GROUP BY ALL")
def registry_first_wins(spark, sf_dir):
    """A TABLE_MAP for each order, whose table is named by its priority, in files by ranges of orders; the first of each table id is kept and parsed."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("table_id"), "o_orderkey", F.col("o_orderpriority").alias("name"), F.format_string("%012d", F.floor(F.col("o_orderkey") / 4096)).alias("_file"))

    @F.pandas_udf("binary")
    def define(ids: pd.Series, names: pd.Series) -> pd.Series:
        info = lambda i, name: mysql.TableInfo("shop", name, (mysql.TYPES["LONGLONG"],) * (1 + i % 3), (0,) * (1 + i % 3), (True,) * (1 + i % 3))
        return pd.Series([mysql.table_map_body(int(i), info(int(i), name)) for i, name in zip(ids, names, strict=True)], dtype=object)

    @F.pandas_udf("name string, n_columns int")
    def parsed(data: pd.Series) -> pd.DataFrame:
        found = [mysql.parse_table_map(bytes(d))[1] for d in data]
        return pd.DataFrame({"name": [i.name for i in found], "n_columns": [len(i.types) for i in found]})

    maps = binlog.event_packets(o, binlog.EVENTS["TABLE_MAP"], define("table_id", "name"), F.lit(0), "_file", [F.col("o_orderkey")])
    kept = rows.definitions_of(events.view(events.headers(maps), "TABLE_MAP"))
    return kept.select("table_id", parsed("definition").alias("p")).select("table_id", "p.*")


_CODECS = "(VALUES " + ", ".join(f"({c})" for c in codecs.POOL) + ") AS k(codec)"
_PROFILE = "(VALUES " + ", ".join(f"({c}, {g}::DOUBLE, {b}::DOUBLE)" for c in codecs.POOL for g, b in [logs.profile_of(c)]) + ") AS p(codec, gain, bw)"
#: Columns that count as measured in the queries, by codec: those of an even codec id with 's' in their name are missing.
_MISSING = "(codec % 2 = 0 AND contains(column_name, 's'))"


def _profile(spark, sizes):
    return sizes.select("column_name").distinct().join(F.broadcast(logs.literal_profile(spark)), F.lit(True))


def _codec_table(spark):
    return spark.createDataFrame([(c,) for c in codecs.POOL], "codec int")


@query(f"SELECT DISTINCT column_name, codec FROM ({_SIZES}), {_CODECS} WHERE {_MISSING}")
def missing_profile(spark, sf_dir):
    """Columns and codecs without a measurement."""
    sizes = _line_sizes(spark, sf_dir)
    return planner.missing_profiles(sizes, _codec_table(spark), _profile(spark, sizes).where(f"NOT {_MISSING}"))


@query(f"""
    SELECT block_no, column_name, codec, lo, least(1000, ori_len - lo) AS byte_num FROM (
        SELECT block_no, column_name, codec, ori_len, (row_number() OVER (PARTITION BY block_no, column_name ORDER BY codec) - 1) * 1000 AS lo FROM ({_SIZES}), {_CODECS} WHERE {_MISSING}) WHERE ori_len > lo""")
def sample_plan(spark, sf_dir):
    """Samples of 1000 bytes for what is missing."""
    sizes = _line_sizes(spark, sf_dir)
    plan = planner.sample_plan(sizes, missing_profile(spark, sf_dir), ["block_no"], 1000)
    return plan.select("block_no", "column_name", "codec", "lo", "byte_num")


@query(f"""
    SELECT block_no, arg_min(codec, (-score, codec)) AS codec, max(score) AS score FROM (
        SELECT block_no, codec, round(least({BANDWIDTH}, sum(ori_len / gain) / sum(ori_len / bw)) * sum(ori_len) / sum(ori_len / gain), 3) AS score FROM ({_SIZES}), {_PROFILE} GROUP BY block_no, codec) GROUP BY block_no""")
def one_best(spark, sf_dir):
    """The best single codec of each block."""
    sizes = _line_sizes(spark, sf_dir)
    return planner.one_best(sizes, _profile(spark, sizes), ["block_no"], BANDWIDTH)


_OPTIONS = f"SELECT block_no, column_name, codec, ori_len / (gain * {BANDWIDTH}) AS send, ori_len / bw - ori_len / (gain * {BANDWIDTH}) AS over FROM ({_SIZES}), {_PROFILE}"
_OPTIMUM = f"""
    WITH o AS MATERIALIZED ({_OPTIONS}),
    lambdas AS (SELECT DISTINCT a.block_no, (a.send - b.send) / (b.over - a.over) AS x FROM o a JOIN o b USING (block_no, column_name) WHERE a.codec <> b.codec AND b.over <> a.over AND (a.send - b.send) / (b.over - a.over) > 0
                UNION SELECT DISTINCT block_no, 0.0 FROM o),
    dual AS (SELECT block_no, x, sum(least_cost) AS value FROM (SELECT l.block_no, l.x, o.column_name, min(send + l.x * over) AS least_cost FROM lambdas l JOIN o USING (block_no) GROUP BY ALL) GROUP BY ALL)
    SELECT block_no, max(value) AS optimum FROM dual GROUP BY block_no"""


@query(f"SELECT block_no, round(optimum, 7) AS objective, 0 AS status, total AS planned FROM ({_OPTIMUM}) JOIN (SELECT block_no, sum(ori_len)::BIGINT AS total FROM ({_SIZES}) GROUP BY 1) USING (block_no)")
def lp_plan(spark, sf_dir):
    """The optimum of the first program of each block, and that its plan takes all bytes."""
    sizes = _line_sizes(spark, sf_dir)
    plan = planner.lp_plan(sizes, _profile(spark, sizes), ["block_no"], BANDWIDTH)
    return plan.groupBy("block_no").agg(F.round(F.first("objective"), 7).alias("objective"), F.first("status").alias("status"), F.sum("byte_num").cast("long").alias("planned"))


@query(f"SELECT block_no, optimum < {planner.TARGET} AS below FROM ({_OPTIMUM})")
def lp_objective_switch(spark, sf_dir):
    """Whether sending takes so little that the second program is asked."""
    sizes = _line_sizes(spark, sf_dir)
    plan = planner.lp_plan(sizes, _profile(spark, sizes), ["block_no"], BANDWIDTH)
    return plan.groupBy("block_no").agg((F.first("objective") < planner.TARGET).alias("below"))


@query(f"""
    SELECT block_no, column_name, arg_min(codec, pack + send)::INTEGER AS codec, any_value(ori_len)::BIGINT AS byte_num
    FROM (SELECT block_no, column_name, codec, ori_len, ori_len / bw AS pack, ori_len / (gain * {BANDWIDTH}) AS send FROM ({_SIZES}), {_PROFILE}) JOIN ({_OPTIMUM}) USING (block_no)
    WHERE optimum < {planner.TARGET} GROUP BY block_no, column_name""")
def lp_second_plan(spark, sf_dir):
    """What the second program gives each column of the blocks that switch to it; these are short of the target, so each column has the codec of the least sum."""
    sizes = _line_sizes(spark, sf_dir)
    plan = planner.lp_plan(sizes, _profile(spark, sizes), ["block_no"], BANDWIDTH)
    return plan.where("switched").select("block_no", "column_name", "codec", "byte_num")


@query("""
    WITH RECURSIVE v AS (SELECT user_id % 40 AS key, value, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS i FROM events),
    f AS (SELECT key, i, value AS kept, 1 AS changes FROM v WHERE i = 1
          UNION ALL
          SELECT v.key, v.i, CASE WHEN abs(v.value - kept) > 0.05 * abs(kept) THEN v.value ELSE kept END, changes + CASE WHEN abs(v.value - kept) > 0.05 * abs(kept) THEN 1 ELSE 0 END FROM f JOIN v ON v.key = f.key AND v.i = f.i + 1)
    SELECT key, arg_max(round(kept, 6), i) AS kept, arg_max(changes, i)::BIGINT AS changes FROM f GROUP BY key""")
def profile_hysteresis(spark, sf_dir):
    """Measurements that change a kept value only when they are off by five percent."""
    e = table(spark, sf_dir, "events").withColumn("key", F.col("user_id") % 40)
    return profile.fold_values(e, "value", ["key"], ["event_id"]).select("key", F.round("kept", 6).alias("kept"), "changes")


@query("""
    SELECT event_type, count(*) AS n, round(avg(c), 9) AS mean_change FROM (
        SELECT event_type, CASE WHEN before <> 0 THEN abs(value - before) / nullif(value, 0) END AS c
        FROM (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events)) WHERE c <= 0.2 GROUP BY 1""")
def profile_drift(spark, sf_dir):
    """Mean of the small relative changes."""
    return profile.drift(table(spark, sf_dir, "events"), "value", ["event_type"], ["event_id"]).withColumn("mean_change", F.round("mean_change", 9))


@query(f"""
    SELECT c.column_name, p.codec, gain, bw FROM (SELECT DISTINCT column_name FROM ({_SIZES})) c, {_PROFILE} WHERE p.codec <> 151
    UNION ALL SELECT DISTINCT column_name, 151, 1.0, 1e12 FROM ({_SIZES})""")
def noop_profile_union(spark, sf_dir):
    """The profile with no compression for every column."""
    sizes = _line_sizes(spark, sf_dir)
    return planner.with_plain(_profile(spark, sizes), sizes)


# -- transport and metrics ------------------------------------------------------

_BLOCKS = "(SELECT event_id // 500 AS block_no, count(*) AS n_events, sum(24 + strlen(props))::BIGINT AS ori_len FROM events GROUP BY 1)"


def _event_blocks(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 500).alias("block_no")).agg(F.count("*").alias("n_events"), F.sum(F.octet_length("props") + 24).cast("long").alias("ori_len"))


@query(f"""
    SELECT block_no, ori_len, ori_len // 3 AS cmpr_len, n_events AS total_events, round(block_no * 0.001 + (ori_len // 3) * 2 / {BANDWIDTH}, 9) AS latency_s, round(ori_len / greatest(ori_len // 3, 1), 9) AS gain FROM {_BLOCKS}""")
def package_latency(spark, sf_dir):
    """Package headers written and parsed, and what the receiver reports."""
    b = _event_blocks(spark, sf_dir)
    cmpr, start = F.floor(F.col("ori_len") / 3), F.col("block_no") * 10_000_000
    fields = {"ori_len": F.col("ori_len"), "cmpr_len": cmpr, "start_ts": start, "total_events": F.col("n_events"), "tran_start_ts": start + F.col("block_no") * 1_000_000, "net_bw": F.lit(int(BANDWIDTH)), "cmpr_threads": F.lit(2)}
    sent = b.select("block_no", transport.package_header(fields).alias("header"))
    got = sent.select("block_no", *[c.alias(n) for n, c in transport.parse_header("header").items()])
    return transport.received_metrics(got).select("block_no", "ori_len", "cmpr_len", "total_events", F.round("latency_s", 9).alias("latency_s"), F.round("gain", 9).alias("gain"))


@query(f"SELECT block_no, column_name, codec, round(ori_len / bw, 9) AS compress_s, round(ori_len / (gain * {BANDWIDTH}), 9) AS transmit_s, round(greatest(ori_len / bw, ori_len / (gain * {BANDWIDTH})), 9) AS theoretical_s FROM ({_SIZES}), {_PROFILE}")
def theoretical_times(spark, sf_dir):
    """Seconds of each column under each codec."""
    sizes = _line_sizes(spark, sf_dir)
    joined = sizes.join(_profile(spark, sizes), "column_name")
    times = planner.theoretical_times(F.col("ori_len"), F.col("gain"), F.col("bw"), BANDWIDTH)
    return joined.select("block_no", "column_name", "codec", *[F.round(c, 9).alias(n) for n, c in times.items()])


@query("""SELECT event_id, sum(24 + strlen(props) - CASE WHEN event_type = 'purchase' THEN 60 ELSE 30 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS in_flight FROM events""")
def bytes_in_flight(spark, sf_dir):
    """Bytes sent less bytes acknowledged, by user."""
    e = table(spark, sf_dir, "events")
    out = transport.bytes_in_flight(e, ["user_id"], ["event_id"], F.octet_length("props") + 24, F.when(F.col("event_type") == "purchase", 60).otherwise(30))
    return out.select("event_id", "in_flight")


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 2000000 ELSE 2000000 - 800001 + (o_orderkey % 5) * 2 * 800001 // 4 END AS rate FROM orders")
def bandwidth_ladder(spark, sf_dir):
    """The rate of each write on the ladder."""
    return table(spark, sf_dir, "orders").select("o_orderkey", transport.ladder_rate(F.col("o_orderkey"), int(BANDWIDTH), 800_001).alias("rate"))


@query("""SELECT event_id, CASE WHEN s < 3 THEN 2000000 ELSE ('0x' || substr(md5('1111:' || (s // 3)), 1, 15))::BIGINT % 1600000 + 1200000 END AS rate
    FROM (SELECT event_id, floor(epoch(ts))::BIGINT - min(floor(epoch(ts))::BIGINT) OVER () AS s FROM events)""")
def bandwidth_walk(spark, sf_dir):
    """The rate at each event of a bandwidth that is drawn anew every three seconds."""
    e = table(spark, sf_dir, "events").select("event_id", seconds("ts").alias("s"))
    start = e.agg(F.min("s").alias("start"))
    return e.join(F.broadcast(start)).select("event_id", transport.walk_rate(F.col("s") - F.col("start"), int(BANDWIDTH), 800_000).alias("rate"))


@query("SELECT event_id, round(CASE WHEN n > 30 THEN greatest(0, (n / 1000 - 0.01) * 2) ELSE 0 END, 9)::DOUBLE AS sleep_s FROM (SELECT event_id, 24 + strlen(props) AS n FROM events)")
def throttle_sleep(spark, sf_dir):
    """How long a rate-limited writer sleeps after each write."""
    n = F.octet_length("props") + 24
    return table(spark, sf_dir, "events").select("event_id", F.round(transport.throttle_seconds(n, F.lit(1000.0), F.lit(0.01), F.lit(2), 30), 9).alias("sleep_s"))


@query("""
    WITH RECURSIVE v AS (SELECT user_id % 20 AS key, event_id / 40.0::DOUBLE AS tm, (24 + strlen(props))::DOUBLE AS n, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS i FROM events),
    f AS (SELECT key, 0::BIGINT AS i, 0.0::DOUBLE AS have, NULL::DOUBLE AS next, -1e18::DOUBLE AS free, 0.0::DOUBLE AS waited FROM v WHERE i = 1
          UNION ALL
          SELECT key, i, CASE WHEN k > 0 THEN have + k * 15.0 - n WHEN n > 30 THEN have - n ELSE have END, CASE WHEN k > 0 THEN greatest(moment, next) + k * 0.25 ELSE next END,
                 CASE WHEN k > 0 THEN greatest(moment, next) + (k - 1) * 0.25 ELSE moment END, waited + CASE WHEN k > 0 THEN greatest(moment, next) + (k - 1) * 0.25 - moment ELSE 0 END
          FROM (SELECT v.key, v.i, v.n, f.have, f.waited, greatest(v.tm, f.free) AS moment, coalesce(f.next, greatest(v.tm, f.free)) AS next, CASE WHEN v.n > 30 THEN greatest(0, ceil((v.n - f.have) / 15.0)) ELSE 0 END AS k
                FROM f JOIN v ON v.key = f.key AND v.i = f.i + 1))
    SELECT key, max(i) AS n_writes, round(arg_max(waited, i), 6) AS waited_s, round(arg_max(have, i), 6) AS tokens FROM f GROUP BY key""")
def token_bucket(spark, sf_dir):
    """Waits at a token bucket of each key's writes: 60 bytes a second in fills of a quarter of one; writes of up to 30 bytes pass."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("key"), "event_id", (F.col("event_id") / 40.0).alias("at"), (F.octet_length("props") + 24).alias("n"))
    out = transport.token_bucket(e, ["key"], ["event_id"], "n", "at", 60.0, 0.25, threshold=30.0)
    return out.select("key", "n_writes", F.round("waited_s", 6).alias("waited_s"), F.round("tokens", 6).alias("tokens"))


@query("""
    SELECT lang, count(*) AS n, round(avg(r), 9) AS mean, round(var_samp(r), 9) AS variance, round(min(r), 9) AS least, round(max(r), 9) AS largest FROM (
        SELECT lang, (strlen(text) // 3)::DOUBLE / strlen(text) AS r FROM documents WHERE strlen(text) > 0) GROUP BY lang""")
def ratio_stats(spark, sf_dir):
    """Statistics of a fixed ratio by language."""
    d = table(spark, sf_dir, "documents").where(F.octet_length("text") > 0)
    n = F.octet_length("text")
    out = stats.ratio_stats(d, ["lang"], F.floor(n / 3) / n)
    return out.select("lang", "n", *[F.round(c, 9).alias(c) for c in ("mean", "variance", "least", "largest")])


@query(f"""
    SELECT block_no, sum(ori_len) OVER (ORDER BY block_no)::BIGINT AS received, sum(ori_len) OVER (ORDER BY block_no) >= (SELECT sum(ori_len) FROM {_BLOCKS}) AS done FROM {_BLOCKS}""")
def completion_check(spark, sf_dir):
    """Bytes received so far, and whether that is all."""
    b = _event_blocks(spark, sf_dir).withColumn("stream", F.lit(0))
    total = b.agg(F.sum("ori_len").alias("total"))
    done = transport.completed(b.join(F.broadcast(total), F.lit(True)), ["stream"], ["block_no"], F.col("total"))
    return done.select("block_no", "received", "done")


@query("""
    WITH e AS (SELECT user_id, event_id, (24 + strlen(props))::DOUBLE AS n, floor(epoch(ts))::BIGINT AS t FROM events),
    p AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY event_id) > 5 THEN 1 ELSE 0 END AS p FROM e),
    s AS (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY event_id) AS span FROM p)
    SELECT event_id, round(coalesce(last_value(CASE WHEN n >= 32 THEN n / 0.25 END IGNORE NULLS) OVER (PARTITION BY user_id, span ORDER BY event_id), 1000.0), 6) AS bandwidth FROM s""")
def bandwidth_feedback(spark, sf_dir):
    """The bandwidth known after each send, reset by pauses."""
    e = table(spark, sf_dir, "events")
    out = transport.bandwidth_feedback(e, ["user_id"], ["event_id"], F.octet_length("props") + 24, F.lit(0.25), seconds("ts"), 1000.0, 32)
    return out.select("event_id", F.round("bandwidth", 6).alias("bandwidth"))


@query("""SELECT doc_id, part, CASE part WHEN 0 THEN 0 WHEN 1 THEN n * 50 // 100 ELSE n * 80 // 100 END AS lo, CASE part WHEN 0 THEN n * 50 // 100 WHEN 1 THEN n * 80 // 100 ELSE n END AS hi
    FROM (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, unnest([0, 1, 2]) AS part FROM documents)""")
def percent_split(spark, sf_dir):
    """Texts split 50 : 30 : 20 by bytes."""
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    parts = lightweight.percent_split(n, [50, 30, 20])
    ranges = F.array(*[F.struct(F.lit(i).alias("part"), lo.alias("lo"), hi.alias("hi")) for i, (lo, hi) in enumerate(parts)])
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(ranges).alias("r")).select("doc_id", "r.*")


@query("SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, [0, strlen(coalesce(text, '')) * 50 // 100, strlen(coalesce(text, '')) * 80 // 100]::VARCHAR AS starts, sha256(coalesce(text, '')) AS sha FROM documents")
def percent_split_codecs(spark, sf_dir):
    """Texts split 50 : 30 : 20, each part by its own codec, and put together again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("v"))
    parts = d.select("doc_id", codecs.encode_split(F.col("v"), [50, 30, 20], [153, 156, 151]).alias("p"))
    starts = F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["lo"].cast("string")), ", "), F.lit("]"))
    back = parts.select("doc_id", starts.alias("starts"), codecs.decode_split(F.col("p"), 3).alias("v"))
    return back.select("doc_id", F.octet_length("v").cast("long").alias("n_bytes"), "starts", F.sha2("v", 256).alias("sha"))


@query("SELECT event_type AS phase, count(*) AS runs, round(sum(value), 4) AS seconds FROM events GROUP BY 1")
def phase_totals(spark, sf_dir):
    """Sums of timings by phase."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.col("value").alias("seconds"))
    return stats.phase_totals(e, "phase", ["seconds"]).withColumn("seconds", F.round("seconds", 4))


# -- codecs and containers ------------------------------------------------------


def _through(ids: tuple[int, ...]) -> str:
    return "SELECT doc_id, codec, strlen(coalesce(text, ''))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS sha FROM documents, (VALUES " + ", ".join(f"({c})" for c in ids) + ") AS k(codec)"


def _roundtrip(spark, sf_dir, ids):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("v"))
    d = d.withColumn("codec", F.explode(F.array(*[F.lit(c) for c in ids])))
    back = d.select("doc_id", "codec", codecs.decode(codecs.encode(F.col("v"), F.col("codec")), F.col("codec")).alias("v"))
    return back.select("doc_id", "codec", F.octet_length("v").cast("long").alias("n_bytes"), F.sha2("v", 256).alias("sha"))


_FAST, _SLOW = (151, 152, 153, 156, 157, 159, 160, 162), (154, 155, 161)


@query(_through(_FAST))
def codec_roundtrip(spark, sf_dir):
    """Documents through the fast codecs and back."""
    return _roundtrip(spark, sf_dir, _FAST)


@query(_through(_SLOW))
def codec_roundtrip_slow(spark, sf_dir):
    """Documents through the slow codecs and back."""
    return _roundtrip(spark, sf_dir, _SLOW)


@query()
def codec_sizes(spark, sf_dir):
    """Compressed bytes of all documents by codec and language; sizes depend on the libraries."""
    d = table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).cast("binary").alias("v"))
    measured = codecs.measure(d, "v", ["lang"])
    return measured.groupBy("lang", "codec").agg(F.sum("ori_len").alias("ori_len"), F.sum("cmpr_len").alias("cmpr_len"))


@query(f"SELECT o_orderpriority AS file, count(*) + 1 AS n_packets, (sum({ORDER_BYTES}) + {ORDER_MAP_BYTES})::BIGINT AS n_bytes, true AS same FROM orders GROUP BY 1")
def container_roundtrip(spark, sf_dir):
    """Orders as packets, in containers, and as packets again, compared byte for byte."""
    packets = _order_packets(spark, sf_dir)
    cut = blocks.bound_blocks(pipeline.index(packets), FIXED_BYTES)
    keys = ["file", "block_no"]
    placed = packets.join(cut.select("file", "packet_no", "block_no"), ["file", "packet_no"])
    values = pipeline.placed_values(placed, {logs.ORDERS.table_id: logs.ORDERS.info})
    boxes = container.encode_blocks(columns.transpose(values, keys, "packet_no"), blocks.block_summary(cut), keys)
    back = container.restore_packets(container.decode_blocks(boxes, keys), keys)
    want = packets.select("file", F.col("packet_no").alias("place"), pipeline.packet_bytes().alias("want"))
    joined = back.join(want, ["file", "place"], "full_outer")
    return joined.groupBy("file").agg(F.count("*").alias("n_packets"), F.sum(F.octet_length("packet")).cast("long").alias("n_bytes"), F.min(F.col("packet").eqNullSafe(F.col("want"))).alias("same"))


def _order_packets(spark, sf_dir):
    """Orders as packets, written once: what reads them several times doesn't encode them again."""
    return Tables(spark).once("packets", lambda: logs.table_packets(table(spark, sf_dir, "orders"), logs.ORDERS, F.col("o_orderpriority"), ["o_orderkey"]))


def _pipeline(spark, sf_dir, transposed: bool, mode: str):
    """Orders in packages; the packages are cut up again, decoded and compared with the columns, byte for byte."""
    packets = _order_packets(spark, sf_dir)
    options = pipeline.Options(mode=mode, transposed=transposed, block_bytes=FIXED_BYTES, bandwidth=BANDWIDTH, codecs=(151, 152, 156))
    cut = pipeline.begin(packets, options)
    if mode in (pipeline.NORMAL, pipeline.REPLAY):
        options.profile = _profile(spark, cut.columns)
        options.plan = planner.lp_plan(cut.columns, options.profile, pipeline.KEYS, BANDWIDTH).select(*pipeline.KEYS, "column_name", "codec", "byte_num")
    run = pipeline.finish(cut, options)
    return _compared(run.packages, pipeline.restored_columns(pipeline.unpacked(run.packages, run.segments.drop("payload"))), run.columns)


def _compared(packages, back, columns_):
    """Bytes and headers of the packages of each file, and whether the columns that came ``back`` are those that went in."""
    keys = [*pipeline.KEYS, "column_name"]
    compared = columns_.where("ori_len > 0").select(*keys, F.col("values").alias("want")).join(back.where(F.octet_length("values") > 0), keys, "full_outer")
    same = compared.groupBy("file").agg(F.min(F.col("values").eqNullSafe(F.col("want"))).alias("same"))
    read = transport.parse_header("header")
    sent = packages.groupBy("file").agg(F.sum(read["ori_len"]).cast("long").alias("ori_len"), F.min(F.octet_length("header")).alias("header_bytes"))
    return sent.join(same, "file")


_SENT = f"SELECT o_orderpriority AS file, (sum({ORDER_BYTES}) + {ORDER_MAP_BYTES})::BIGINT AS ori_len, 58 AS header_bytes, true AS same FROM orders GROUP BY 1"


@query(_SENT)
def pipeline_transposed(spark, sf_dir):
    """Orders through the whole pipeline and back, a column for each field."""
    return _pipeline(spark, sf_dir, True, "zstd")


@query(_SENT)
def pipeline_untransposed(spark, sf_dir):
    """The same in fixed blocks of the raw stream."""
    return _pipeline(spark, sf_dir, False, "zstd")


@query(_SENT)
def pipeline_normal(spark, sf_dir):
    """The same with a codec mix by linear program for each block of raw bytes."""
    return _pipeline(spark, sf_dir, False, pipeline.NORMAL)


@query(_SENT)
def pipeline_normal_transposed(spark, sf_dir):
    """A codec mix by linear program for each column of each block."""
    return _pipeline(spark, sf_dir, True, pipeline.NORMAL)


@query(_SENT)
def pipeline_one_best(spark, sf_dir):
    """The one best codec of each block, by codecs timed on its columns."""
    return _pipeline(spark, sf_dir, True, pipeline.ONE_BEST)


@query(_SENT)
def pipeline_multi_best(spark, sf_dir):
    """The best mix of each block, by codecs timed on it."""
    return _pipeline(spark, sf_dir, False, pipeline.MULTI_BEST)


@query(_SENT)
def pipeline_replay(spark, sf_dir):
    """A plan that was made before, replayed."""
    return _pipeline(spark, sf_dir, True, pipeline.REPLAY)


def _adaptive(spark, sf_dir, transposed: bool):
    """Orders as logs through the adaptive loop, some parts a trigger, and back; the packages are cut up, decoded and compared with the columns, byte for byte."""
    folder = _written(spark, sf_dir)
    size = sum(n for _, n in sized_files(f"{folder}/in"))
    log = Manifest(spark, f"{folder}/in", f"{folder}/manifest", split_bytes=max(64 << 10, size // 6), unit_bytes=max(64 << 10, size // 3))
    log.refresh()
    options = pipeline.Options(transposed=transposed, block_bytes=FIXED_BYTES, bandwidth=BANDWIDTH, codecs=(151, 152, 156))
    adaptive = loop.Loop(spark, f"{folder}/run", options, unit=2000)
    query = adaptive.start(log.stream(units_per_trigger=1), f"{folder}/checkpoint")
    query.awaitTermination()
    sent, directory = adaptive.read("packages"), adaptive.read("segments").drop("payload")
    return _compared(sent, pipeline.restored_columns(pipeline.unpacked(sent, directory)), adaptive.read("columns"))


@query(_SENT.replace("o_orderpriority AS file", "regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g') AS file"))
def stream_adaptive(spark, sf_dir):
    """The adaptive loop over a stream, a column for each field: samples, plans, measurements and packages, trigger by trigger."""
    return _adaptive(spark, sf_dir, True)


@query(ORACLES["stream_adaptive"])
def stream_adaptive_untransposed(spark, sf_dir):
    """The same over blocks of raw bytes."""
    return _adaptive(spark, sf_dir, False)


@query(f"""
    SELECT (sum({ORDER_BYTES}) + count(DISTINCT o_orderpriority) * {ORDER_MAP_BYTES})::BIGINT AS ori_len, (count(*) + count(DISTINCT o_orderpriority))::BIGINT AS total_events, true AS same, 0::BIGINT AS strangers FROM orders""")
def package_roundtrip(spark, sf_dir):
    """Packages of the orders sent to files and received again: what their headers add up to, and that each payload is one that was sent."""
    options = pipeline.Options(mode="zstd1", transposed=False, whole_packets=True, block_bytes=FIXED_BYTES, bandwidth=BANDWIDTH)
    run = pipeline.run(_order_packets(spark, sf_dir), options)
    folder = f"{run.tables.folder}/wire"
    wire.send(run.packages, folder)
    got = wire.receive(spark, folder)
    read = transport.parse_header("header")
    digest = lambda df: df.groupBy(F.sha2(F.concat("header", "payload"), 256).alias("sha")).agg(F.count("*").alias("n"))
    sent = digest(run.packages).withColumnRenamed("n", "sent")
    matched = digest(got).join(sent, "sha", "full_outer").agg(F.min(F.col("n").eqNullSafe(F.col("sent"))).alias("same"), F.sum(F.when(F.col("sent").isNull(), 1).otherwise(0)).alias("strangers"))
    summed = got.agg(F.sum(read["ori_len"]).cast("long").alias("ori_len"), F.sum(read["total_events"]).cast("long").alias("total_events"))
    # one row each
    return summed.join(F.broadcast(matched), F.lit(True))


_KINDS = ("FORMAT_DESCRIPTION", "TRANSACTION_PAYLOAD", "PREVIOUS_GTIDS", "ANONYMOUS_GTID", "ROTATE", "QUERY", "XID", "STOP")


@query(f"""
    SELECT file, packet_no, event_type, CASE kind
        WHEN 0 THEN '4|8.0.' || o_orderkey || '|' || o_custkey || '|19' WHEN 1 THEN o_orderstatus || o_orderkey WHEN 2 THEN '07|' || o_orderpriority WHEN 3 THEN o_orderpriority || o_orderstatus
        WHEN 4 THEN o_custkey || '|log.' || o_orderkey WHEN 5 THEN o_custkey || '|' || (o_orderkey % 1000) || '|3|' || o_orderstatus || '|' || o_orderpriority || '|UPDATE t SET x = ' || o_orderkey WHEN 6 THEN o_orderkey::VARCHAR ELSE '' END AS detail
    FROM (SELECT *, o_orderkey % 8 AS kind, [{", ".join(str(binlog.EVENTS[k]) for k in _KINDS)}][(o_orderkey % 8 + 1)::INTEGER] AS event_type, o_orderpriority AS file, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS packet_no FROM orders)""")
def event_kinds(spark, sf_dir):
    """Events of all kinds without rows, a kind for each order in turn, as packets and decoded again."""
    o = table(spark, sf_dir, "orders")
    le = lambda c, n: fb.to_little_endian(F.col(c) if isinstance(c, str) else c, n)
    text = lambda *c: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in c]).cast("binary")
    key, customer, status, priority = (F.col(f"o_{c}") for c in ("orderkey", "custkey", "orderstatus", "orderpriority"))
    version = text("8.0.", key)
    bodies = (
        F.concat(le(F.lit(4), 2), F.substring(F.concat(version, F.unhex(F.lit("00" * 50))), 1, 50), le(customer, 4), le(F.lit(19), 1)),
        text(status, key), F.concat(F.unhex(F.lit("07")), text(priority)), text(priority, status), F.concat(le(customer, 8), text("log.", key)),
        F.concat(le(customer, 4), le(key % 1000, 4), le(F.octet_length(status), 1), le(F.lit(3), 2), le(F.octet_length(priority), 2), text(priority), text(status), text("UPDATE t SET x = ", key)),
        le(key, 8), text(""),
    )
    pick = lambda options: F.element_at(F.array(*options), (key % len(_KINDS) + 1).cast("int"))
    packets = binlog.event_packets(o.withColumn("_file", priority), pick([F.lit(binlog.EVENTS[k]) for k in _KINDS]), pick(bodies), F.lit(0), "_file", [key])
    heads = events.headers(packets)
    fields = {
        "FORMAT_DESCRIPTION": ("version", "server_version", "created", "header_len"), "TRANSACTION_PAYLOAD": ("payload",), "PREVIOUS_GTIDS": ("gtid_flags", "gtids"), "ANONYMOUS_GTID": ("gtid",), "ROTATE": ("position", "next_name"),
        "QUERY": ("thread_id", "exec_time", "error_code", "db", "status_vars", "sql"), "XID": ("xid",), "STOP": (),
    }
    shown = lambda c: F.lower(F.hex(c)) if c == "gtid_flags" else F.col(c).cast("string")
    found = [events.view(heads, k).select("file", "packet_no", F.lit(binlog.EVENTS[k]).alias("event_type"), F.concat_ws("|", F.lit("") if not fields[k] else shown(fields[k][0]), *[shown(c) for c in fields[k][1:]]).alias("detail")) for k in _KINDS]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@query()
def block_size_study(spark, sf_dir):
    """Ratios of each codec by block size over the benchmark's texts."""
    b = table(spark, sf_dir, "benchmark").select(F.lit("text").alias("column_name"), F.col("text").cast("binary").alias("v"))
    study = stats.block_study(b, "v", ["column_name"], stats.SMALL_SIZES, (152, 153, 156, 157))
    return study.select("column_name", "block_size", "codec", "n", "ori_len", "cmpr_len", *[F.round(c, 9).alias(c) for c in ("mean", "variance", "least", "largest")])


@query()
def column_size_study(spark, sf_dir):
    """Ratios of all codecs of the pool over the columns of the orders log, in pieces of 1 to 1000 KiB; sizes depend on the libraries."""
    packets = _order_packets(spark, sf_dir)
    cut = pipeline.cut_columns(packets, pipeline.Options(mode="zstd", block_bytes=10 << 20))[0]
    study = stats.block_study(cut, "values", ["column_name"], tuple(1024 * k for k in stats.COLUMN_SIZES))
    return study.select("column_name", "block_size", "codec", "n", "ori_len", "cmpr_len", *[F.round(c, 9).alias(c) for c in ("mean", "variance", "least", "largest")])
