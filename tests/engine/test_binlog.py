"""Packets to rows and back: decoding against the tables that were encoded, containers byte for byte, streams against batches."""

import random
import time
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colsync.functions import mysql
from colsync.operators import blocks, columns, container, events, rows
from colsync.plans import logs, pipeline
from colsync.sources import binlog, framing
from colsync.sources.binlog import EVENTS, event_body, packet, read_packets, write_file
from colsync.sources.manifest import Manifest

SF = "/root/testdata/sf0.001"


def tiny(path):
    """Every handled kind, two tables, odd packets between."""
    info = mysql.TableInfo("db", "t", (8, 15, 5, 18), (0, 40, 8, 6), (True,) * 4)
    other = mysql.TableInfo("db", "t2", (3,), (0,), (False,))

    def row(values, included=b"\x0f", nulls=b"\x00"):
        return (7).to_bytes(6, "little") + b"\0\0" + b"\2\0" + b"\4" + included + b"".join(values) + b"CRC!"

    image = lambda i, s: (i).to_bytes(8, "little") + bytes([len(s)]) + s + np.float64(i / 2).tobytes() + mysql.pack_datetime2(np.array([1_700_000_000_000_000 + i]), 6).tobytes()
    bodies = [
        event_body(EVENTS["FORMAT_DESCRIPTION"], b"\4\0" + b"8.0.30".ljust(50, b"\0") + (99).to_bytes(4, "little") + b"\x13" + b"rest"),
        event_body(EVENTS["PREVIOUS_GTIDS"], b"\1gtids"),
        event_body(EVENTS["ANONYMOUS_GTID"], b"anon", ts=5),
        event_body(EVENTS["QUERY"], (3).to_bytes(4, "little") + (4).to_bytes(4, "little") + b"\2" + (0).to_bytes(2, "little") + (5).to_bytes(2, "little") + b"STATE" + b"db" + b"\0BEGIN"),
        event_body(EVENTS["TABLE_MAP"], mysql.table_map_body(7, info), ts=6),
        event_body(EVENTS["WRITE_ROWS"], row([b"\x00", image(1, b"ab"), b"\x00", image(2, b"")]), ts=7, next_pos=900),
        event_body(EVENTS["WRITE_ROWS"], row([b"\x02", image(3, b"")[:8] + image(3, b"")[9:]]), ts=8),
        event_body(EVENTS["TABLE_MAP"], mysql.table_map_body(7, other)),
        event_body(EVENTS["XID"], (77).to_bytes(8, "little") + b"CRC!"),
        event_body(EVENTS["ROTATE"], (4).to_bytes(8, "little") + b"log.2"),
        event_body(EVENTS["TRANSACTION_PAYLOAD"], b"packed"),
        event_body(EVENTS["STOP"], b""),
        event_body(EVENTS["UPDATE_ROWS"], b"whatever"),
        b"err",
    ]
    write_file(path, bodies, [0] * 13 + [255])
    return info


@pytest.fixture()
def log(tmp_path):
    path = str(tmp_path / "log.1")
    return path, tiny(path)


def test_source_and_views(spark, log):
    path, info = log
    packets = read_packets(spark, path)
    heads = events.headers(packets)
    assert heads.count() == 14 and events.raw(heads).count() == 2
    with pytest.raises(Exception, match="no view"):
        events.raw(heads, fail_fast=True).collect()
    one = lambda kind: events.view(heads, kind).collect()[0]
    assert (one("FORMAT_DESCRIPTION").version, one("FORMAT_DESCRIPTION").server_version, one("FORMAT_DESCRIPTION").header_len) == (4, "8.0.30", 19)
    q = one("QUERY")
    assert (q.thread_id, q.exec_time, q.db, bytes(q.status_vars), bytes(q.sql)) == (3, 4, "db", b"STATE", b"\0BEGIN")
    assert one("XID").xid == 77 and bytes(one("ROTATE").next_name) == b"log.2" and bytes(one("PREVIOUS_GTIDS").gtids) == b"gtids"
    w = one("WRITE_ROWS")
    assert (w.table_id, w.extra_len, w.n_columns, bytes(w.included), bytes(w.checksum)) == (7, 2, 4, b"\x0f", b"CRC!")
    registry = rows.registry_of(events.view(heads, "TABLE_MAP"))
    assert registry == {7: info}
    images = rows.row_images(events.view(heads, "WRITE_ROWS"), registry)
    typed = rows.typed_rows(images, info, ["id", "name", "half", "at"]).orderBy("id").collect()
    assert [(r.id, r.name, r.half) for r in typed] == [(1, "ab", 0.5), (2, "", 1.0), (3, None, 1.5)]
    assert typed[0].at == datetime(2023, 11, 14, 22, 13, 20, 1)
    counts = {r.event_name: r.n_events for r in events.event_counts(heads).collect()}
    assert counts["WRITE_ROWS"] == 2 and counts["OTHER"] == 1


def test_torn_files(spark, tmp_path):
    path = str(tmp_path / "torn")
    whole = packet(event_body(EVENTS["XID"], b"12345678"))
    with open(path, "wb") as f:
        f.write(whole * 2 + whole[:5])
    with pytest.raises(Exception, match="no whole packet"):
        read_packets(spark, path).collect()
    open(path, "wb").close()
    assert read_packets(spark, path).count() == 0


def test_stream_is_batch(spark, tmp_path):
    from colsync.streaming import state

    state.use_rocksdb(spark)
    folder = tmp_path / "logs"
    folder.mkdir()
    log = Manifest(spark, str(folder), str(tmp_path / "manifest"), split_bytes=100, unit_bytes=250)

    def run():
        log.refresh()
        return state.package_sink(log.stream(), str(tmp_path / "out"), str(tmp_path / "ck"), 120)

    tiny(str(folder / "a"))
    run()
    tiny(str(folder / "b"))
    more = packet(event_body(EVENTS["XID"], b"12345678"), 14)
    with open(folder / "a", "ab") as f:
        f.write(more + more[:9])  # the second one is not all there yet
    run()
    with open(folder / "a", "ab") as f:
        f.write(more[9:])
    run()
    batch = read_packets(spark, str(folder))
    seen = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(str, seen.collect())) == sorted(map(str, batch.collect()))
    assert log.refresh() == 0  # nothing new
    # another stream over the same notes, a few bytes a trigger
    query = state.package_sink(log.stream(units_per_trigger=1), str(tmp_path / "slow"), str(tmp_path / "ck3"), 300)
    triggers = [r.n for r in spark.read.parquet(str(tmp_path / "slow")).groupBy("batch").agg(F.sum(F.col("body_len") + 4).alias("n")).collect()]
    assert query.exception() is None and len(triggers) == spark.read.text(log.folder).select(F.input_file_name()).distinct().count() > 3
    assert max(triggers) <= 250 + 100 + 200 and sum(triggers) == seen.agg(F.sum(F.col("body_len") + 4)).first()[0]
    registry = state.registry_stream(log.stream())
    state.package_sink(registry, str(tmp_path / "reg"), str(tmp_path / "ck2"), 120)
    kept = spark.read.parquet(str(tmp_path / "reg")).collect()
    assert [(r.table_id, mysql.parse_table_map(bytes.fromhex(r.data))[1].name) for r in kept] == [(7, "t")]


def test_idle_bandwidth_and_reports(spark, tmp_path):
    from colsync.streaming import state

    state.use_rocksdb(spark)
    source = tmp_path / "sends"
    fields = "link string, at double, n_bytes long, seconds double"
    for i, link in enumerate(["a", "a", "b"]):
        spark.createDataFrame([(link, float(i), 1000 * (i + 1), 0.5), (link, i + 0.5, 10, 0.5)], fields).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.1)
    sends = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(str(source))
    seen = []  # a timer's batch has no rows
    watch = state.report(spark, "sends", lambda batch, values: seen.append((batch, values["rows"], values["bytes"])))
    known = state.bandwidth_stream(state.observed(sends, "sends", "n_bytes"), ["link"], start=7.0, least=100, idle=0.001)
    query = state.package_sink(known, str(tmp_path / "out"), str(tmp_path / "ck"), processingTime="100 milliseconds")
    got, until = {}, time.time() + 60
    while time.time() < until and not (got.get("b", [])[-1:] == got.get("a", [])[-1:] == [(7.0, True)] and len(seen) >= 3):
        time.sleep(0.5)
        if query.lastProgress and query.lastProgress["batchId"] >= 3:
            got = {}
            for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect():
                got.setdefault(r.link, []).append((r.bandwidth, r.idle))
    query.stop()
    spark.streams.removeListener(watch)
    assert [x for x in got["a"] if not x[1]] == [(2000.0, False), (4000.0, False)] and got["a"][-1] == (7.0, True)
    assert got["b"] == [(6000.0, False), (7.0, True)]
    assert [x[1:] for x in sorted(seen) if x[1]] == [(2, 1010), (2, 2010), (2, 3010)]


def test_tables_through_packets(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    back = logs.decoded(logs.table_packets(orders, logs.ORDERS, F.col("o_orderpriority"), ["o_orderkey"]), logs.ORDERS)
    assert sorted(map(tuple, back.select(*logs.ORDERS.columns).collect())) == sorted(map(tuple, orders.select(*logs.ORDERS.columns).collect()))


@pytest.mark.parametrize("mode,transposed", [("zstd", True), ("lz4", False), ("normal", True), ("normal", False), ("oneBest", True), ("multiBest", False), ("nocompression", True)])
def test_pipeline_modes(spark, mode, transposed):
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 300")
    packets = logs.table_packets(orders, logs.ORDERS, F.lit("all"), ["o_orderkey"]).cache()
    options = pipeline.Options(mode=mode, transposed=transposed, block_bytes=8000, bandwidth=1e6, profile=logs.literal_profile(spark) if mode == "normal" else None)
    if mode == "normal":
        cut, _ = pipeline.cut_columns(packets, options)
        options.profile = cut.select("column_name").distinct().crossJoin(F.broadcast(logs.literal_profile(spark)))
    run = pipeline.run(packets, options)
    want = {(r.file, r.block_no, r.column_name): bytes(r["values"]) for r in run.columns.collect()}
    coded = run.segments.cache()
    got = {(r.file, r.block_no, r.column_name): bytes(r["values"]) for r in pipeline.restored_columns(coded).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    sent = run.packages.collect()
    assert len(sent) == run.blocks.count() > 1 and all(len(p.header) == 58 for p in sent)
    assert sum(p.ori_len for p in sent) == packets.agg(F.sum(F.col("body_len") + 4)).first()[0]


def _measured(cut, speeds):
    """Timings of each block as a table would have them: a tenth of the bytes, in the time that ``speeds`` gives a codec in a block."""
    rows_ = [(r.file, r.block_no, r.column_name, c, r.ori_len, max(1, r.ori_len // 10), r.ori_len / speeds(r.block_no, c), 0.0) for r in cut.columns.collect() for c in (151, 152, 156)]
    return cut.columns.sparkSession.createDataFrame(rows_, "file string, block_no long, column_name string, codec int, ori_len long, cmpr_len long, seconds double, decode_seconds double")


@pytest.mark.parametrize("mode,transposed", [("oneBest", False), ("oneBest", True), ("multiBest", True)])
def test_each_block_has_the_codec_of_its_own_timings(spark, mode, transposed):
    """A run over a folder takes the timings and the plan that are there; blocks of one stream differ in their codecs."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 300")
    packets = logs.table_packets(orders, logs.ORDERS, F.lit("all"), ["o_orderkey"]).cache()
    options = pipeline.Options(mode=mode, transposed=transposed, block_bytes=6000, bandwidth=1e5, codecs=(151, 152, 156))
    cut = pipeline.begin(packets, options)
    fast = lambda block, c: {151: 1e3, 152: 1e7 if block % 2 else 1e4, 156: 1e4 if block % 2 else 1e7}[c]
    cut.tables.once("measured", lambda: _measured(cut, fast))
    first = pipeline.run(packets, options, cut.tables.folder)
    used = {(r.block_no, r.codec) for r in first.plan.where("codec <> 151").collect()}
    blocks_ = {r.block_no for r in first.blocks.collect()}
    assert len(blocks_) > 2 and used == {(b, 152 if b % 2 else 156) for b in blocks_}
    want = {(r.block_no, bytes(r.payload)) for r in first.packages.collect()}
    # a run that has died: segments half written, packages not at all, and other timings by now
    import shutil

    folder = cut.tables.folder
    for name in ("packages", "measured"):
        shutil.rmtree(f"{folder}/{name}")
    (Path(folder) / "segments" / "_SUCCESS").unlink()
    cut.tables.once("measured", lambda: _measured(cut, lambda block, c: fast(block + 1, c)))
    again = pipeline.run(packets, options, folder)
    assert {(r.block_no, bytes(r.payload)) for r in again.packages.collect()} == want
    back = pipeline.restored_columns(pipeline.unpacked(again.packages, again.segments.drop("payload")))
    assert {(r.block_no, r.column_name): bytes(r["values"]) for r in back.collect() if r["values"]} == {(r.block_no, r.column_name): bytes(r["values"]) for r in again.columns.collect() if r["values"]}
    again.tables.clear()
    assert not Path(folder).exists()


def test_lost_events_stop_the_pipeline(spark, monkeypatch):
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 50")
    packets = logs.table_packets(orders, logs.ORDERS, F.lit("all"), ["o_orderkey"])
    options = pipeline.Options(mode="zstd", block_bytes=6000)
    whole = pipeline.cut_columns
    monkeypatch.setattr(pipeline, "cut_columns", lambda p, o, *more: (whole(p.where("packet_no <> 3"), o, *more)[0], whole(p, o, *more)[1]))
    with pytest.raises(Exception, match="lost events"):
        pipeline.run(packets, options)


def test_container_round_trip(spark, log):
    path, _ = log
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 200")
    for packets in (read_packets(spark, path), logs.table_packets(orders, logs.ORDERS, F.lit("all"), ["o_orderkey"])):
        packets = packets.where(events.is_event()).where(F.conv(F.hex(F.substring("body", 5, 1)), 16, 10).cast("int") != EVENTS["UPDATE_ROWS"]).cache()
        heads = events.headers(packets)
        images = rows.row_images(events.view(heads, "WRITE_ROWS"), rows.registry_of(events.view(heads, "TABLE_MAP")))
        cut = blocks.bound_blocks(pipeline.index(packets), 3000)
        summary = blocks.block_summary(cut)
        single = images.groupBy("file", "packet_no").count().where("count > 1").select("file", "packet_no")
        values = columns.event_values(heads, images).join(single, ["file", "packet_no"], "left_anti").join(cut.select("file", "packet_no", "block_no"), ["file", "packet_no"])
        turned = columns.transpose(values, ["file", "block_no"], "packet_no")
        boxes = container.encode_blocks(turned, summary, ["file", "block_no"])
        back = container.restore_packets(container.decode_blocks(boxes, ["file", "block_no"]), ["file", "block_no"])
        want = packets.join(single, ["file", "packet_no"], "left_anti").select("file", F.col("packet_no").alias("place"), pipeline.packet_bytes().alias("packet"))
        got = {(r.file, r.place): bytes(r.packet) for r in back.collect()}
        assert got == {(r.file, r.place): bytes(r.packet) for r in want.collect()}
        each = {(r.file, r.column_name, r.place): bytes(r.value) for r in columns.untranspose(turned, ["file", "block_no"]).collect()}
        assert each == {(r.file, r.column_name, r.packet_no): bytes(r.value) for r in values.collect()}


def test_vectors():
    t = {"800000.00": "00:00:00", "7FFFFF.FF": "-00:00:00.01", "7FFFFF.9D": "-00:00:00.99", "7FFFFF.00": "-00:00:01", "7FFFFE.FF": "-00:00:01.01", "7FFFFE.F6": "-00:00:01.10"}
    for raw, text in t.items():
        assert mysql.time2_text(bytes.fromhex(raw.replace(".", "")), 2) == text
    for value, p, s in ((Decimal("12345678901234.5678"), 18, 4), (Decimal("-0.05"), 4, 2), (Decimal("0"), 10, 0), (Decimal("-999999999.99"), 11, 2), (Decimal("7"), 65, 30)):
        text = mysql.decimal_text(mysql.pack_decimal(value, p, s), p, s)
        assert Decimal(text) == value and text.startswith("-") == (value < 0)


def test_logs_are_written_as_they_were(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        tiny(str(tmp_path / "in" / name))
    for _ in range(2):  # a second time replaces the files
        binlog.write_log(read_packets(spark, str(tmp_path / "in")).repartition(7), f"file://{tmp_path}/out")
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["a", "b"]
    for name in ("a", "b"):
        assert (tmp_path / "out" / name).read_bytes() == (tmp_path / "in" / name).read_bytes()


def test_large_files_are_read_in_parts(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    rng = random.Random(3)
    for k in range(3):
        binlog.write_file(str(folder / f"f{k}"), [event_body(EVENTS["XID"], bytes(rng.randrange(256) for _ in range(rng.randint(0, 400)))) for _ in range(200 * k)])
    whole = read_packets(spark, str(folder))
    for path in (str(folder), f"file://{folder}", str(folder / "f*")):
        parts = read_packets(spark, path, split_bytes=3000)
        assert parts.rdd.getNumPartitions() > 20
        assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    with open(folder / "f1", "ab") as f:
        f.write(b"\x09\x00\x00\x01\x00torn")
    with pytest.raises(Exception, match="no whole packet"):
        read_packets(spark, str(folder), split_bytes=3000).collect()



def test_framing_of_misleading_files(spark, tmp_path):
    """Values that hold whole logs, packets that are no events, huge and empty ones, and a torn end: parts are the chain from the start."""
    rng = random.Random(9)
    event = lambda n: event_body(EVENTS["XID"], rng.randbytes(n))
    inner = b"".join(packet(event(rng.randint(0, 60)), i) for i in range(300))
    files = {
        "events": [packet(event(rng.randint(0, 300)), i) for i in range(400)],
        "nested": [packet(event(50) if i % 7 else event_body(EVENTS["QUERY"], inner[: rng.randint(500, len(inner))]), i) for i in range(60)],
        "other": [packet(rng.randbytes(rng.randint(0, 90)), i, 255) for i in range(300)],
        "still": [packet(rng.randbytes(rng.randint(0, 90)), 7, 255) for _ in range(90)],
        "empty": [(0).to_bytes(3, "little") + bytes([i & 255]) for i in range(500)],
        "huge": [packet(event(3)), packet(event(90_000), 1), packet(event(3), 2)],
        "torn": [packet(event(40), i) for i in range(100)],
    }
    (tmp_path / "in").mkdir()
    wanted, asked = {}, []
    for name, packets in files.items():
        path = str(tmp_path / "in" / name)
        torn = b"\xff\xff\x00\x09\x00" + inner[:4000] if name == "torn" else b""
        with open(path, "wb") as f:
            f.write(b"".join(packets) + torn)
        wanted[path] = np.cumsum([0, *map(len, packets)])
        asked.append((path, 0, 0, int(wanted[path][-1]) + len(torn)))
    for every in (700, 5000):
        parts, ends = framing.find_parts(spark, asked, every)
        for path, places in wanted.items():
            mine = [p for p in parts if p.path == path]
            assert [p.start for p in mine] == [0, *(p.stop for p in mine[:-1])] and mine[-1].stop == places[-1]
            for p in mine:
                a, b = np.searchsorted(places, [p.start, p.stop])
                assert places[a] == p.start and places[b] == p.stop and p.first == a and p.n == b - a
            assert ends[path] == (places[-1], len(places) - 1)
            assert all(p.stop - p.start <= every + np.diff(places).max() for p in mine)
    with pytest.raises(Exception, match="no whole packet"):
        read_packets(spark, str(tmp_path / "in"), split_bytes=700).collect()
    (tmp_path / "in" / "torn").unlink()
    whole, cut = read_packets(spark, str(tmp_path / "in")), read_packets(spark, str(tmp_path / "in"), split_bytes=700)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect())) and whole.count() == sum(len(p) for n, p in files.items() if n != "torn")


def test_no_task_reads_more_than_its_range(tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    write_file(path, [event_body(EVENTS["XID"], bytes(40))] * 5000)
    monkeypatch.setattr(framing, "CHUNK", 512)
    read = []
    monkeypatch.setattr(framing.Window, "at", lambda self, place, n, old=framing.Window.at: (read.append((place, n)), old(self, place, n))[1])
    size = (tmp_path / "log").stat().st_size
    ask = pa.RecordBatch.from_pylist([{"path": path, "lo": 64_000, "hi": 96_000, "size": size, "at": -1, "known": -1}])
    [out] = framing._walk_ranges(iter([ask]))
    assert out.column("at")[0].as_py() >= 64_000 and 96_000 <= out.column("out")[0].as_py() < 96_100
    assert min(p for p, _ in read) == 64_000 and max(p + n for p, n in read) < 97_000


def test_blocks_of_a_stream(spark, tmp_path):
    from colsync.streaming import state

    state.use_rocksdb(spark)
    rng = random.Random(4)
    index = []
    for file, n in (("a", 700), ("b", 90), ("c", 1)):
        at, kind = 0, True
        for i in range(n):
            kind = rng.choice([kind] * 30 + [True, False, None])
            size = rng.choice([1, 30, 200, 900, 5000])
            index.append((file, i, at, size, kind))
            at += size
    fields = "file string, packet_no long, offset long, packet_len long, class boolean"
    # batches that overlap, out of order, one of them sent twice
    cut = sorted(index, key=lambda r: (r[1] // 100 + rng.choice([0, 0, 0, 2]), rng.random()))
    for lo in [*range(0, len(cut), 90), 90]:
        spark.createDataFrame(cut[lo : lo + 90], fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    state.package_sink(state.block_stream(stream, 1500), str(tmp_path / "out"), str(tmp_path / "ck"), 300)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() > 3
    want = blocks.bound_blocks(spark.createDataFrame(index, fields), 1500)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    # a hole in a file's bytes is an error
    spark.createDataFrame([("d", 0, 0, 10, True), ("d", 1, 11, 10, True)], fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="don't follow"):
        state.package_sink(state.block_stream(stream, 1500), str(tmp_path / "out"), str(tmp_path / "ck"), 300)


def test_definitions_without_a_driver(spark, monkeypatch):
    """More tables than the driver may hold: rows meet their definitions in a join, a hot table's in many tasks."""
    monkeypatch.setattr(rows, "MAX_TABLES", 100)
    types = lambda i: (8, 3, 1)[i % 3]
    info = lambda i: mysql.TableInfo("db", f"t{i}", (types(i),), (0,), (True,))
    maps = [("f", i, i, bytearray(mysql.table_map_body(i, info(i)))) for i in range(3000)] + [("g", i, i, bytearray(mysql.table_map_body(i, info(i + 1)))) for i in range(0, 3000, 7)]
    size = {8: 8, 3: 4, 1: 1}
    body = lambda i, v: i.to_bytes(6, "little") + b"\0\0\2\0\1\1\0" + v.to_bytes(size[types(i)], "little") + b"CRC!"
    events_ = [("f", 10_000 + i, i, bytearray(body(i, i % 100))) for i in range(3000)] + [("f", 20_000 + k, 5, bytearray(body(5, k % 100))) for k in range(2000)]
    fields = "file string, packet_no long, table_id long, data binary"
    maps, events_ = spark.createDataFrame(maps, fields), spark.createDataFrame(events_, fields)
    images = rows.row_images(events_, rows.definitions_of(maps))
    got = {(r.packet_no, r.table_id): int.from_bytes(r["values"][0], "little") for r in images.collect()}
    assert len(got) == 5000 and all(v == (i % 100 if n < 20_000 else (n - 20_000) % 100) for (n, i), v in got.items())
    with pytest.raises(ValueError, match="more than"):
        rows.registry_of(maps)
    with pytest.raises(Exception, match="no TABLE_MAP"):
        rows.row_images(events_, rows.definitions_of(maps.where("table_id <> 5"))).collect()


@pytest.mark.parametrize("transposed", [True, False])
def test_adaptive_loop(spark, tmp_path, transposed):
    """Each pair is sampled once, then planned by what was measured; nothing is lost; a trigger that is tried again changes nothing."""
    from colsync.streaming.loop import Loop

    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 900")
    binlog.write_log(logs.table_packets(orders, logs.ORDERS, F.lit("all"), ["o_orderkey"]), str(tmp_path / "in"))
    size = (tmp_path / "in" / "all").stat().st_size
    log = Manifest(spark, str(tmp_path / "in"), str(tmp_path / "manifest"), split_bytes=size // 3, unit_bytes=size // 3)
    assert log.refresh() >= 3
    options = pipeline.Options(transposed=transposed, block_bytes=9000, bandwidth=1e5, codecs=(151, 152, 156))
    adaptive = Loop(spark, str(tmp_path / "run"), options, unit=300, least_send=1000)
    adaptive.start(log.stream(units_per_trigger=1), str(tmp_path / "ck")).awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "run").iterdir())
    assert last >= 2
    # lossless: columns of all triggers from the packages alone and the directory
    sent, directory = adaptive.read("packages"), adaptive.read("segments").drop("payload")
    back = {(r.file, r.block_no, r.column_name): bytes(r["values"]) for r in pipeline.restored_columns(pipeline.unpacked(sent, directory)).collect()}
    want = {(r.file, r.block_no, r.column_name): bytes(r["values"]) for r in adaptive.read("columns").collect()}
    assert {k: v for k, v in back.items() if v} == {k: v for k, v in want.items() if v}
    assert sum(r.ori_len for r in adaptive.read("blocks").collect()) == size
    numbers = sorted(r.block_no for r in adaptive.read("blocks").collect())
    assert numbers == list(range(len(numbers)))
    # every pair of a column with enough bytes in a block is in the profile, and was sampled in one block of the trigger that lacked it
    kept = {(r.column_name, r.codec): r for r in adaptive.state("profile", last).collect()}
    long = {k[2] for k, v in want.items() if len(v) >= 2 * 300}
    assert {(c, x) for c in long for x in (152, 156)} <= set(kept)
    first = spark.read.parquet(str(tmp_path / "run" / "batch=0" / "plan")).where("codec <> 151").collect()
    assert len({(r.column_name, r.codec) for r in first}) == len(first) and all(r.byte_num <= 300 for r in first)
    later = spark.read.parquet(str(tmp_path / "run" / f"batch={last}" / "plan")).where("codec <> 151 AND byte_num > 300")
    assert later.count() > 0  # the program uses what was measured
    # kept values move by the rule only: those of the last trigger are its own, or those before it
    before = {(r.column_name, r.codec): r for r in adaptive.state("profile", last - 1).collect()}
    sums = {}
    for r in spark.read.parquet(str(tmp_path / "run" / f"batch={last}" / "segments")).where("byte_num >= 300 AND codec <> 151").collect():
        o, c, s = sums.get((r.column_name, r.codec), (0, 0, 0.0))
        sums[r.column_name, r.codec] = o + r.byte_num, c + r.cmpr_len, s + r.seconds
    for pair, r in kept.items():
        old, new = before.get(pair), sums.get(pair)
        moved = new is not None and (old is None or abs(new[0] / new[1] - old.gain) > 0.05 * old.gain or abs(new[0] / new[2] - old.bw) > 0.05 * old.bw)
        assert (r.epoch == last) == moved
        assert np.isclose(r.gain, new[0] / new[1] if moved else old.gain)
    # the same trigger again, after its packages were lost
    import shutil

    payloads = {(r.file, r.block_no): bytes(r.payload) for r in sent.collect()}
    for name in ("packages", "segments"):
        shutil.rmtree(tmp_path / "run" / f"batch={last}" / name)
    adaptive.step(spark.read.parquet(str(tmp_path / "run" / f"batch={last}" / "arrived")), last)
    assert {(r.file, r.block_no): bytes(r.payload) for r in adaptive.read("packages").collect()} == payloads


def test_loop_waits_for_packets_in_front(spark, tmp_path):
    from colsync.streaming.loop import Loop, gaps

    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 300")
    packets = logs.table_packets(orders, logs.ORDERS, F.col("o_orderpriority"), ["o_orderkey"]).cache()
    adaptive = Loop(spark, str(tmp_path), pipeline.Options(block_bytes=3000, bandwidth=1e5, codecs=(151, 152)), unit=200)
    turn = F.pmod(F.floor(F.col("packet_no") / 10), F.lit(3))
    for number, k in enumerate((2, 0, 1)):  # the definition comes second
        adaptive.step(packets.where(turn == k), number)
    missing = {r.file: r.gap for r in gaps(packets.where("packet_no <> 4 AND packet_no <> 9"), spark.createDataFrame([], "file string, next_packet long")).collect()}
    assert set(missing.values()) == {5}
    assert [adaptive.state("early", n).count() > 0 for n in (1, 2)] == [True, False]
    sent, directory = adaptive.read("packages"), adaptive.read("segments").drop("payload")
    back = {(r.file, r.block_no, r.column_name): bytes(r["values"]) for r in pipeline.restored_columns(pipeline.unpacked(sent, directory)).collect()}
    want = {(r.file, r.block_no, r.column_name): bytes(r["values"]) for r in adaptive.read("columns").collect()}
    assert {k: v for k, v in back.items() if v} == {k: v for k, v in want.items() if v}
    assert sum(r.ori_len for r in adaptive.read("blocks").collect()) == packets.agg(F.sum(F.col("body_len") + 4)).first()[0]


def test_packages_are_committed_or_not_there(spark, tmp_path):
    import os

    from pyspark.sql.types import BinaryType

    from colsync.operators.transport import package_header
    from colsync.sources import packages as wire

    rng = random.Random(8)
    payloads = [rng.randbytes(rng.choice([0, 1, 300, 5000])) for _ in range(60)]
    df = spark.createDataFrame([(f"f{i % 4}", i, bytearray(p)) for i, p in enumerate(payloads)], "file string, block_no long, payload binary")
    size = F.octet_length("payload").cast("long")
    fields = dict.fromkeys(("start_ts", "tran_start_ts", "net_bw", "cmpr_threads"), F.col("block_no")) | {"ori_len": size * 3, "cmpr_len": size, "total_events": F.lit(2)}
    sent = df.withColumn("header", package_header(fields))
    folder = str(tmp_path / "wire")
    files = lambda: {f for f in os.listdir(folder)}
    assert wire.receive(spark, folder).count() == 0
    wire.send(sent, folder)
    key = lambda d: sorted((bytes(r.header), bytes(r.payload)) for r in d.collect())
    assert key(wire.receive(spark, folder)) == key(sent)
    rows_ = wire.receive(spark, folder).orderBy("package_file", "package_no").collect()
    assert all(a.package_file != b.package_file or b.package_no == a.package_no + 1 for a, b in zip(rows_, rows_[1:], strict=False))
    # one task fails: nothing of the others stays
    before = files()
    spark.dataSource.register(wire.PackageDataSource)
    bad = F.udf(lambda p, n: bytes(p) if n != 41 else 1 // 0, BinaryType())
    with pytest.raises(Exception, match="division"):
        sent.withColumn("payload", bad("payload", "block_no")).repartition(5).select("header", "payload").write.format("packages").mode("append").save(folder)
    with pytest.raises(Exception, match="doesn't go with"):
        sent.withColumn("payload", F.concat("payload", F.lit(b"x"))).select("header", "payload").write.format("packages").mode("append").save(folder)
    assert files() == before
    wire.send(sent.where("block_no < 7"), folder)
    assert wire.receive(spark, folder).count() == 67
    wire.send(sent.where("block_no < 5"), folder, "overwrite")
    assert key(wire.receive(spark, folder)) == key(sent.where("block_no < 5"))
    # a batch of a stream that is tried again replaces itself
    for messages in ([wire._write(folder, iter([pa.RecordBatch.from_pylist([{"header": h, "payload": p}]) for h, p in key(sent.where("block_no < 3"))]))], []):
        wire._StreamWriter(folder).commit(messages, 4)
        assert wire.receive(spark, folder).count() == 5 + 3 * len(messages)
    # bytes that are missing, or too many, or an end that says something else
    [whole] = wire._write(str(tmp_path), iter([pa.RecordBatch.from_pylist([{"header": h, "payload": p}]) for h, p in key(sent)])).files
    data = (tmp_path / whole).read_bytes()
    assert list(wire.read_file(str(tmp_path / whole))) == key(sent)
    for broken in (data[:-1], data[:-34], data[: len(data) // 2], data + b"x", data[:-1] + b"\x01", b"\x07\x00" + data):
        (tmp_path / "broken").write_bytes(broken)
        with pytest.raises((EOFError, ValueError)):
            list(wire.read_file(str(tmp_path / "broken")))


def test_packages_of_a_stream(spark, tmp_path):
    from colsync.operators.transport import package_header
    from colsync.sources import packages as wire

    fields = dict.fromkeys(("ori_len", "cmpr_len", "start_ts", "total_events", "tran_start_ts", "net_bw", "cmpr_threads"), F.col("n"))
    rows_ = spark.range(1, 40).select(F.col("id").alias("n")).withColumn("header", package_header(fields)).withColumn("payload", F.encode(F.repeat(F.lit("p"), F.col("n").cast("int")), "utf-8"))
    rows_.select("header", "payload").repartition(6).write.parquet(str(tmp_path / "in"))
    spark.dataSource.register(wire.PackageDataSource)
    stream = spark.readStream.schema("header binary, payload binary").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for _ in range(2):
        query = stream.writeStream.format("packages").option("path", str(tmp_path / "wire")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(200)
    got = wire.receive(spark, str(tmp_path / "wire"))
    assert sorted(len(r.payload) for r in got.collect()) == list(range(1, 40))
    assert len([f for f in (tmp_path / "wire").iterdir() if f.name.startswith("_commit-batch-")]) == 3
