"""What a task holds and repeats: values in slices, equal values measured once, columns without their block's bytes."""

import lzma

import pyarrow as pa
from pyspark.sql import functions as F

from colsync.functions.batches import BATCH_BYTES
from colsync.operators import blocks, codecs, columns, events, rows, stats
from colsync.plans import logs, pipeline


def test_values_are_coded_in_slices(spark):
    values = pa.array([b"x" * (3 << 20)] * 3 + [None, b"", b"y" * (9 << 20), b"z"])
    found = list(codecs._slices(values))
    assert found[0][0] == 0 and found[-1][1] == len(values) and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    assert all(hi - lo == 1 or sum(len(v.as_py() or b"") for v in values[lo:hi]) <= codecs.SLICE for lo, hi in found)
    rows = [(i, None if i == 5 else bytearray(b"abc" * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, v binary")
    back = df.select("i", codecs.decode(codecs.encode("v", 153), 153).alias("v"), codecs.decode_split(codecs.encode_split(F.col("v"), [50, 30, 20], [153, 156, 151]), 3).alias("w"))
    assert {r.i: (r.v, r.w) for r in back.collect()} == {i: (v, v) for i, v in rows}


def test_short_values_by_xz_are_as_short():
    for n in (0, 1, 100, 5000, 70_000):
        value = bytes(i * i % 251 for i in range(n))
        assert len(codecs.CODECS[161].encode(value)) == len(lzma.compress(value)) and lzma.decompress(codecs.CODECS[161].encode(value)) == value
    # the dictionary's size as the header of the block says it: 4 KB, not 8 MB
    assert codecs.CODECS[161].encode(b"abc")[16] == 0 and lzma.compress(b"abc")[16] == 22


def test_equal_values_are_measured_once(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "calls")

    def encode(x):
        with open(log, "a") as file:
            file.write("x\n")
        return x[:1]

    monkeypatch.setitem(codecs.CODECS, 201, codecs.Codec(201, "counting", encode, lambda x: x))
    df = spark.createDataFrame([("a", bytearray(b"k" * 950)), ("b", bytearray(b"k" * 900))] * 20, "column_name string, v binary").coalesce(1)
    got = {(r.column_name, r.block_size): (r.n, r.ori_len, r.cmpr_len, r.mean, r.variance) for r in stats.block_study(df, "v", ["column_name"], (100,), (201,)).collect()}
    assert got["b", 100][:3] == (180, 18000, 180) and got["a", 100][:3] == (200, 19000, 200)
    # two pieces that differ, of 380; the means don't measure them again
    assert len(open(log).readlines()) == 2


def test_columns_come_apart_without_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(columns, "PASSED_ON", 7)
    rows = [("f", k, f"c{k % 3}", i, None if k == 4 and i else bytearray(bytes([i % 251]) * (i % 5))) for k in range(6) for i in range(30)]
    df = spark.createDataFrame(rows, "file string, block_no long, column_name string, place long, value binary")
    turned = columns.transpose(df.where("value IS NOT NULL"), ["file", "block_no"], "place")
    back = columns.untranspose(turned, ["file", "block_no"])
    assert {(r.file, r.block_no, r.column_name, r.place, bytes(r.value)) for r in back.collect()} == {(*r[:4], bytes(r[4])) for r in rows if r[4] is not None}
    # no sort or window over rows that hold a whole column
    assert "Window" not in back._jdf.queryExecution().toString()


def test_files_are_numbered_in_ranges(spark):
    orders = spark.range(5000).select(F.when(F.col("id") != 7, F.col("id")).alias("o_orderkey"), F.col("id").alias("o_custkey"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.lit("2020-01-01").cast("timestamp_ntz").alias("o_orderdate"), F.when(F.col("id") % 10 > 0, "hot").otherwise(None).alias("o_orderpriority"))
    packets = logs.table_packets(orders, logs.ORDERS, F.col("o_orderpriority"), ["o_orderkey"])
    for file in ("hot", None):
        got = sorted(packets.where(F.col("file").eqNullSafe(F.lit(file))).select("packet_no", "offset", "body_len").collect())
        at = 0
        for i, r in enumerate(got):
            assert (r.packet_no, r.offset) == (i, at)
            at += r.body_len + 4
        assert len(got) == (4501 if file else 501)
    assert [r.o_orderkey for r in logs.decoded(packets, logs.ORDERS).where("file = 'hot'").orderBy("packet_no").collect()] == [None, *(i for i in range(5000) if i % 10 and i != 7)]
    plan = packets._jdf.queryExecution().toString()
    assert "partitionBy" not in plan and "hashpartitioning(file" in plan and "_range" in plan


def test_values_meet_their_blocks_as_packets(spark):
    orders = spark.range(300).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.lit("2020-01-01").cast("timestamp_ntz").alias("o_orderdate"), F.lit("p").alias("o_orderpriority"))
    packets = logs.table_packets(orders, logs.ORDERS, F.lit("all"), ["o_orderkey"])
    cut, _ = pipeline.cut_columns(packets, pipeline.Options(mode="zstd", block_bytes=6000))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    # every join is below the rows for each value
    deep = lambda x: len(x) - len(x.lstrip(" :+-"))
    lines = plan.split("\n")
    for i, x in enumerate(lines):
        if "Join Inner" in x:
            above = [y for y in lines[:i] if deep(y) < deep(x) and "Generate explode" in y]
            assert above, x
    heads = events.headers(packets)
    held = blocks.bound_blocks(pipeline.index(packets), 6000).select("file", "packet_no", "block_no")
    images = rows.row_images(events.view(heads, "WRITE_ROWS"), pipeline.definitions(packets))
    want = columns.transpose(columns.event_values(heads, images).join(held, ["file", "packet_no"]), pipeline.KEYS, "packet_no")
    key = lambda r: (r.file, r.block_no, r.column_name)
    assert sorted(cut.collect(), key=key) == sorted(want.collect(), key=key)


def test_codecs_get_batches_of_a_few_megabytes(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    packets = spark.createDataFrame([], "file string, packet_no long, offset long, body_len int, seq smallint, flag smallint, body binary")
    wide = spark.range(0, 300, 1, 1).selectExpr("id", "cast(repeat('x', 65536) as binary) AS value")

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    try:
        spark.conf.set(setting, "64m")
        pipeline.begin(packets, pipeline.Options(mode="zstd", transposed=False))
        assert max(r.n for r in wide.mapInArrow(seen, "n long").collect()) <= BATCH_BYTES + (1 << 17)
        spark.conf.set(setting, "1m")
        pipeline.begin(packets, pipeline.Options(mode="zstd", transposed=False))
        assert spark.conf.get(setting) == "1m"
    finally:
        spark.conf.set(setting, before)


def test_decoded_values_are_passed_on_in_slices(spark):
    long = codecs.CODECS[153].encode(bytes(1 << 20))
    values = pa.array([long, None, b""] * 20, pa.binary())
    found = list(codecs._function("decode").func(iter([(pa.array([153] * 60), values)])))
    assert len(values) == sum(map(len, found)) and len(found) > 1
    assert max(part.nbytes for part in found) <= codecs.SLICE + (1 << 20) + 4096
    assert pa.chunked_array(found).to_pylist() == [bytes(1 << 20), None, b""] * 20
