"""Codecs, plans and transport against plain versions and published vectors."""

import hashlib
import random
from itertools import product

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colsync.operators import blocks, codecs, columns, container, lightweight, stats, transport
from colsync.plans import logs, planner, profile, simplex

U32 = st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300)), max_size=60)


@given(U32)
@settings(max_examples=200, deadline=None)
def test_byte_codecs(values):
    v = np.array(values, np.uint32)
    assert (lightweight.delta_decode(lightweight.delta_encode(v)) == v).all()
    assert (lightweight.dod_decode(lightweight.dod_encode(v), len(v)) == v).all()
    assert (lightweight.varint_decode(lightweight.varint_encode(v)) == v).all()
    wide = v.view(np.uint8).reshape(-1, 4)
    assert (lightweight.rle_decode(lightweight.rle_encode(wide), 4) == wide).all()
    raw = v.tobytes()
    assert lightweight.byte_rle_decode(lightweight.byte_rle_encode(raw)) == raw
    for codec in codecs.CODECS.values():
        if codec.available:
            assert codec.decode(codec.encode(raw)) == raw
    for tag in range(6):
        chunk = container.encode_chunk([x.tobytes() for x in v], tag)
        assert container.decode_chunk(chunk, 0) == ([x.tobytes() for x in v], len(chunk))


def test_sizes_are_those_of_the_bytes(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([rng.randint(0, 2**31), 1000 + i * 7 + rng.randint(-3, 3)])) for k in range(8) for i in range([0, 1, 2, 3, 40, 41, 200, 7][k])]
    df = spark.createDataFrame(rows, "k int, i int, v long")
    delta = {r.k: r.encoded_bytes for r in lightweight.delta_size(df, "v", ["k"], ["i"]).collect()}
    dod = {r.k: r.encoded_bytes for r in lightweight.dod_size(df, "v", ["k"], ["i"]).collect()}
    for k in delta:
        v = np.array([x for a, _, x in rows if a == k], np.uint32)
        assert delta[k] == len(lightweight.delta_encode(v))
        steps = np.diff(np.diff(v.astype(np.int64)))
        if len(v) < 3 or (np.abs(steps) < 2**31).all():
            assert dod[k] == len(lightweight.dod_encode(v))


def test_greedy_cut():
    rng = random.Random(5)
    for _ in range(300):
        n, size = rng.randint(1, 40), rng.randint(1, 60)
        lengths = np.array([rng.randint(1, 30) for _ in range(n)])
        kinds = np.array([rng.random() < 0.8 for _ in range(n)])
        offsets = np.cumsum(lengths) - lengths
        want, start, number = [], 0, 0
        for i in range(n):
            if i and (offsets[i] - offsets[start] > size or kinds[i] != kinds[start]):
                start, number = i, number + 1
            want.append(number)
        cutter, got = blocks.Cutter(size), []
        parts = sorted({0, n, *(rng.randint(0, n) for _ in range(rng.randint(0, 4)))})
        for a, b in zip(parts, parts[1:], strict=False):
            got += cutter.cut(offsets[a:b], kinds[a:b]).tolist()
        assert got == want


@pytest.mark.parametrize("stretch", [40, 300, None])
def test_greedy_cut_in_stretches(spark, stretch):
    rng = random.Random(6)
    rows, want = [], set()
    for file in ("a", "b", "c", "d"):
        offset, start, number, kind = 0, 0, -1, None
        for i in range({"a": 400, "b": 1, "c": 90, "d": 200}[file]):
            size, now = rng.choice([0, 5, 9, 30, 130]), None if rng.random() < 0.02 else rng.random() < 0.95
            if number < 0 or offset - start > 60 or now is not kind:
                start, number, kind = offset, number + 1, now
            rows.append((file, i, offset, size, now))
            want.add((file, i, number, offset, size, now))
            offset += size
    index = spark.createDataFrame(rows, "file string, packet_no long, offset long, packet_len long, class boolean").repartition(5)
    assert {tuple(r) for r in blocks.bound_blocks(index, 60, stretch).collect()} == want
    assert blocks.bound_blocks(index.limit(0), 60, stretch).collect() == []


@pytest.mark.parametrize("order", ["i", "s", "t"])
def test_offsets_over_ranges(spark, order):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), i, f"{i:05d}", rng.randint(0, 50)) for i in range(500)] + [("hot", None, None, 3), ("null only", None, None, 4)]
    df = spark.createDataFrame(rows, "f string, i int, s string, n int").withColumn("t", F.timestamp_seconds("i")).repartition(4)
    got = {(r.f, r.i): r.offset for r in blocks.packet_offsets(df, F.col("n"), ["f"], [order], 16).collect()}
    at, want = {}, {}
    for f, i, _, n in sorted(rows, key=lambda r: -1 if r[1] is None else r[1]):
        want[f, i] = at.get(f, 0)
        at[f] = want[f, i] + n
    assert got == want
    assert blocks.packet_offsets(df.limit(0), F.col("n"), ["f"], [order]).collect() == []


@pytest.mark.parametrize(
    "c,a,b,aeq,beq,bounds,x,fun",
    [
        ([-1, -2], [[-1, 2], [3, 1]], [4, 9], None, None, None, [2, 3], -8),
        ([-5, -10], [[1, 3], [4, 2], [1, 0]], [50, 60, 5], None, None, None, [5, 15], -175),
        ([-1, 4], [[-3, 1], [1, 2]], [6, 4], None, None, [(None, None), (-3, None)], [10, -3], -22),
        ([-3, 2, 1, -1], [[4, -1, 0, 1], [7, -8, -1, 0]], [6, -7], [[1, 1, 0, 4]], [12], None, None, -2.235294117647059),
    ],
)
def test_programs(c, a, b, aeq, beq, bounds, x, fun):
    for bland in (False, True):
        got = simplex.solve(c, a, b, aeq, beq, bounds, bland=bland)
        assert got.success and np.isclose(got.fun, fun)
        assert x is None or np.allclose(got.x, x)
        assert (got.slack > -1e-9).all()


def test_program_ends():
    assert simplex.solve([0, -2, -1], [[1, 1, -2], [-3, 1, 2]], [7, 3]).status == simplex.UNBOUNDED
    assert simplex.solve([1, 1, 1], [[-1, 2, 1], [1, 0, -2]], [1, -4], [[1, -1, 2]], [4]).status == simplex.INFEASIBLE
    assert simplex.solve([-1, -2], [[-1, 2], [3, 1]], [4, 9], maxiter=1).status == simplex.LIMIT
    assert np.allclose(simplex.solve([-1, -1], bounds=[(0, 2), (None, 3)]).x, [2, 3])
    with pytest.raises(ValueError):
        simplex.solve([1, 2], [[1]], [1])
    seen = []
    simplex.solve([-1, -2], [[-1, 2], [3, 1]], [4, 9], callback=lambda t, n, p: seen.append(p))
    assert len(seen) == 2


def test_small_programs_by_vertices():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b, c = rng.integers(-4, 6, (4, 2)), rng.integers(1, 12, 4), rng.integers(-6, 7, 2)
        a, b = np.vstack([a, [[1, 0], [0, 1]]]), np.append(b, [20, 20])
        rows, right = np.vstack([a, -np.eye(2)]), np.append(b, [0, 0])
        best = np.inf
        for i, j in product(range(len(rows)), repeat=2):
            if i < j and abs(np.linalg.det(rows[[i, j]])) > 1e-9:
                x = np.linalg.solve(rows[[i, j]], right[[i, j]])
                if (rows @ x <= right + 1e-9).all():
                    best = min(best, c @ x)
        assert np.isclose(simplex.solve(c, a, b).fun, best)


def test_programs_of_unlike_sizes():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b, c = rng.integers(-4, 6, (4, 3)).astype(float), rng.integers(1, 12, 4).astype(float), rng.integers(-6, 7, 3).astype(float)
        a, b = np.vstack([a, np.eye(3)]), np.append(b, [20, 20, 20])
        plain = simplex.solve(c, a, b, scale=False)
        rows, columns = 10.0 ** rng.integers(-9, 10, 7), 10.0 ** rng.integers(-9, 10, 3)
        got = simplex.solve(c * columns * 1e-7, a * rows[:, None] * columns, b * rows)
        assert got.success and np.isclose(got.fun * 1e7, plain.fun)
        assert np.isclose(got.duals @ (b * rows), got.fun)
    row, column = simplex._scales(np.array([[1e12, 0.0], [3.0, 1e-9]]))
    assert (np.log2(row) % 1 == 0).all() and (np.log2(column) % 1 == 0).all()


def test_allocation():
    rng = random.Random(6)
    for _ in range(30):
        rows = pd.DataFrame([(f"c{k}", c, n, *logs.profile_of(c)) for k, n in enumerate([rng.randint(1, 3_000_000) for _ in range(rng.randint(1, 6))]) for c in codecs.POOL], columns=["column_name", "codec", "ori_len", "gain", "bw"])
        plan, said = planner.allocate(rows, rng.choice([1e4, 1e6, 1e8]))
        assert said["status"] == 0
        sums = plan.groupby("column_name").agg(n=("ori_len", "first"), planned=("byte_num", "sum"))
        assert (sums["n"] == sums["planned"]).all() and (plan["byte_num"] >= 0).all()


def test_small_blocks_go_as_they_are(spark):
    columns = spark.createDataFrame([(1, "a", 40), (1, "b", 59), (2, "a", 100)], "block_no int, column_name string, ori_len long")
    prof = columns.select("column_name").distinct().join(F.broadcast(logs.literal_profile(spark)), F.lit(True))
    got = {(r.block_no, r.column_name): r.codec for r in planner.lp_plan(columns, prof, ["block_no"], 1e4).collect() if r.byte_num}
    assert got[1, "a"] == got[1, "b"] == codecs.NOCOMPRESSION and got[2, "a"] != codecs.NOCOMPRESSION


def test_profile_update_and_stream(spark, tmp_path):
    from colsync.streaming import state

    rows = [(1, "a", 153, 200_000, 100_000, 0.01), (2, "a", 153, 200_000, 99_000, 0.01), (3, "a", 153, 200_000, 50_000, 0.01), (4, "b", 153, 99_999, 10, 0.01), (5, "b", 156, 100_000, 10_000, 0.5)]
    schema = "seq_no long, column_name string, codec int, ori_len long, cmpr_len long, seconds double"
    kept = spark.createDataFrame([], "column_name string, codec int, gain double, bw double, epoch long")
    for i in range(len(rows)):
        kept = spark.createDataFrame(profile.update(kept, spark.createDataFrame(rows[i : i + 1], schema), i + 1).collect(), kept.schema)
    want = {(r.column_name, r.codec): (r.gain, r.epoch) for r in kept.collect()}
    assert want == {("a", 153): (4.0, 3), ("b", 156): (10.0, 5)}
    state.use_rocksdb(spark)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.profile_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    out = []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {(r.column_name, r.codec): (r.gain, r.epoch) for r in out} == want


def test_registered_codec_and_missing_library():
    codecs.register_codec(codecs.Codec(200, "flip", lambda x: x[::-1], lambda x: x[::-1]))
    assert codecs.by_name("flip").decode(codecs.by_name("FLIP").encode(b"abc")) == b"abc"
    del codecs.CODECS[200]
    assert not codecs.by_name("lzo").available
    with pytest.raises(ValueError):
        codecs.encode(F.lit(b""), 158)
    with pytest.raises(ValueError):
        codecs.by_name("none such")


def test_headers(spark):
    df = spark.createDataFrame([(5, 2**40, b"")], "a long, b long, h binary")
    fields = {n: F.lit(i).cast("long") for i, n in enumerate(transport.HEADER_FIELDS)} | {"start_ts": F.col("b")}
    head = df.select(transport.package_header(fields).alias("h"))
    row = head.select(*[c.alias(n) for n, c in transport.parse_header("h").items()]).collect()[0]
    assert row.start_ts == 2**40 and row.cmpr_threads == 6 and len(head.collect()[0].h) == transport.HEADER_BYTES
    with pytest.raises(Exception, match="not a package"):
        df.select(*[c.alias(n) for n, c in transport.parse_header("h").items()]).collect()


def test_block_study(spark):
    df = spark.createDataFrame([("a", b"abc" * 1000), ("b", b"")], "column_name string, v binary")
    got = {(r.block_size, r.codec): r for r in stats.block_study(df, "v", ["column_name"], (100, 1000), (151, 153)).collect()}
    assert got[100, 151].n == 30 and got[100, 151].mean == 1.0 and got[1000, 153].largest < 0.2


def test_sizes_and_modes():
    from colsync.plans import pipeline

    assert pipeline.parse_size("10*1024*1024") == 10 << 20 and pipeline.parse_size("7") == 7
    assert {"normal", "zstd1", "zstd22", "lzo", "oneBest", "multiBest", "flate"} <= set(pipeline.MODES)
    with pytest.raises(ValueError):
        pipeline.parse_size("1+1")


def test_lenenc_reads_whole_texts_back(spark, tmp_path, monkeypatch):
    from colsync.plans import catalogue

    texts = [(1, "é" * 40_000), (2, "x" * 300), (3, None), (4, "y" * 17_000_000)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (n, size, hashlib.sha256((text or "").encode()).hexdigest()) for (i, text), n, size in zip(texts, (80_000, 300, 0, 17_000_000), (4, 3, 1, 9), strict=True)}
    ask = lambda: {r.doc_id: (r.value, r["size"], r["sha"]) for r in catalogue.lenenc_size(spark, str(tmp_path)).collect()}
    assert ask() == want
    read = catalogue.fb.length_encoded_string
    monkeypatch.setattr(catalogue.fb, "length_encoded_string", lambda data, at: catalogue.F.substring(read(data, at), 1, 200))
    cut = ask()
    assert {i for i in want if cut[i] != want[i]} == {1, 2, 4}


def test_profiles_with_zeros_and_negative_values(spark):
    values = [0.0, 0.0, 3.0, 3.1, 4.0, 0.0, -2.0, -2.05, -3.0, 0.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v double")
    kept, changes = None, 0
    for v in values:
        if kept is None or abs(v - kept) > 0.05 * abs(kept):
            kept, changes = v, changes + 1
    assert [tuple(r) for r in profile.fold_values(df, "v", ["k"], ["i"]).collect()] == [(1, kept, changes)]
    small = [abs(b - a) / b for a, b in zip(values, values[1:]) if a and b and abs(b - a) / b <= profile.DRIFT]
    [row] = profile.drift(df, "v", ["k"], ["i"]).collect()
    assert row.n == len(small) and row.mean_change == pytest.approx(sum(small) / len(small))


def test_folds_over_batches(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2, 2, 2, None]), rng.choice(["a", None]), i, rng.choice([None, rng.uniform(-3, 3)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, l string, i int, v double").repartition(3)
    want = {}
    for k, l, _, v in rows:
        kept, changes = want.get((k, l), (None, 0))
        want[k, l] = (v, changes + 1) if kept is None or v is not None and abs(v - kept) > 0.05 * abs(kept) else (kept, changes)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (7, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = profile.fold_values(df, "v", ["k", "l"], ["i"]).collect()
            assert {(r.k, r.l): (r.kept, r.changes) for r in got} == want and len(got) == len(want)
        assert profile.fold_values(df.limit(0), "v", ["k", "l"], ["i"]).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_blocks_without_bytes_have_a_codec(spark):
    columns = spark.createDataFrame([(1, "a", 0), (2, "a", 100)], "block_no int, column_name string, ori_len long")
    rates = spark.createDataFrame([("a", 152, 2.0, 1e6), ("a", 156, 1.5, 1e8)], "column_name string, codec int, gain double, bw double")
    assert {r.block_no: (r.codec, r.score) for r in planner.one_best(columns, rates, ["block_no"], 2e6).collect()} == {1: (152, 0.0), 2: (156, 3e6)}


def test_bandwidth_ladder_and_walk(spark):
    rate, balance = 1000, 401
    steps = [rate - balance + i * (2 * balance) // 4 for i in range(5)]
    want, at, now = [], 0, rate
    for _ in range(12):  # a write, then the next step
        want.append(now)
        at = (at + 1) % 5
        now = steps[at]
    df = spark.range(12)
    assert [r.rate for r in df.select("id", transport.ladder_rate(F.col("id"), rate, balance).alias("rate")).orderBy("id").collect()] == want
    walked = [r.rate for r in spark.range(300).select("id", transport.walk_rate(F.col("id") * 1.0, rate, balance).alias("rate")).orderBy("id").collect()]
    assert walked[:3] == [rate] * 3 and all(rate - balance <= x < rate + balance for x in walked)
    assert all(len(set(walked[i : i + 3])) == 1 for i in range(0, 300, 3)) and len(set(walked)) > 60
    assert {r.rate for r in spark.range(30).select(transport.walk_rate(F.col("id") * 1.0, rate, 0).alias("rate")).collect()} == {rate}


@pytest.mark.parametrize("balance", [0.0, 40.0])
def test_token_bucket_fill_by_fill(spark, balance):
    rng = random.Random(7)
    writes = [(k, i, rng.choice([5, 12, 40, 300, 2500]), i * rng.choice([0.1, 1.0])) for k in range(3) for i in range(40)]
    rate, period, balance_s, threshold = 100.0, 0.25, 1.0, 10

    def plain(rows):
        fill, spread, every = rate * period, balance * period, int(balance_s / period)
        left, count, extra, fills, free, waited, due = 0.0, every, 0.0, 0, float("-inf"), 0.0, None
        for n, at in rows:
            now = begun = max(free, at)
            due = now if due is None else due
            if n > threshold:
                taken = min(left, n)
                left, n = left - taken, n - taken
                while n > 0:
                    now = max(now, due)
                    due, count, fills = now + period, count - 1, fills + 1
                    if count == 0:
                        unit = int(transport.hashlib.md5(f"1111:{fills // every}".encode()).hexdigest()[:15], 16) / float(1 << 60)
                        extra, count = (2 * unit - 1) * spread, every
                    left = fill + extra
                    taken = max(0.0, min(left, n))
                    left, n = left - taken, n - taken
            waited, free = waited + now - begun, now
        return waited, left

    df = spark.createDataFrame(writes, "k int, i int, n int, at double")
    got = {r.k: (r.n_writes, r.waited_s, r.tokens) for r in transport.token_bucket(df, ["k"], ["i"], "n", "at", rate, period, balance=balance, balance_s=balance_s, threshold=threshold).collect()}
    for k in range(3):
        waited, left = plain([(n, at) for a, _, n, at in writes if a == k])
        assert got[k][0] == 40 and got[k][1] == pytest.approx(waited) and got[k][2] == pytest.approx(left)


def test_column_names_and_lost_events(spark):
    df = spark.createDataFrame([("7:12",), ("Timestamps",), ("x:1",), ("7:",)], "name string")
    assert [r.k and tuple(r.k) for r in df.select(columns.split_key(F.col("name")).alias("k")).collect()] == [(7, 12), None, None, None]
    cut = spark.createDataFrame([(1, "BodyLens", 3), (1, "Seqs", 3), (2, "BodyLens", 2)], "block_no int, column_name string, n_values long")
    whole, lost = (spark.createDataFrame([(1, 3), (2, n)], "block_no int, n_events long") for n in (2, 4))
    assert columns.check_counts(cut, whole, ["block_no"]).count() == 3
    with pytest.raises(Exception, match="lost events"):
        columns.check_counts(cut, lost, ["block_no"]).collect()


def test_packages_in_a_folder(spark, tmp_path):
    one, two = (spark.createDataFrame([(k, bytearray(b"x" * k))], "block_no long, payload binary") for k in (1, 2))
    for batch, rows in ((0, one), (1, two), (1, two)):  # a batch that comes again replaces itself
        transport.write_packages(rows, str(tmp_path / "out"), batch)
    assert sorted((r.batch, r.block_no) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 1), (1, 2)]


def test_the_sweep_is_the_first_program(spark):
    """Plans by hulls and prices against the simplex, a block at a time: same objectives, bounds kept, all bytes planned."""
    rng = np.random.default_rng(12)
    sizes, measured = [], []
    for block in range(40):
        for c in range(int(rng.integers(1, 7))):
            sizes.append((block, f"c{c}", int(rng.integers(0, 50) if block == 39 else rng.choice([0, 1, 900, 40_000, 3_000_000]))))
            for codec in rng.choice([152, 153, 154, 155, 156, 157], size=int(rng.integers(0, 6)), replace=False):
                measured.append((block, f"c{c}", int(codec), float(rng.choice([0.8, 1.0, 1.5, 1.5, 3.0, 9.0])), float(rng.choice([1e4, 2e5, 2e5, 1e6, 5e7]))))
    columns_ = spark.createDataFrame(sizes, "block_no long, column_name string, ori_len long")
    prof = spark.createDataFrame(measured, "block_no long, column_name string, codec int, gain double, bw double")
    routes = set()
    for bandwidth, busy, target in ((1e5, 0.0, 0.05), (1e6, 0.4, 30.0), (1e4, 0.0, 1e9), (1e5, 1e4, 0.05)):
        got = {}
        for r in planner.lp_plan(columns_, prof, ["block_no"], bandwidth, busy, target).collect():
            got.setdefault(r.block_no, []).append(r)
        options = planner.with_plain(prof, columns_, ["block_no"]).join(columns_, ["block_no", "column_name"]).where("ori_len > 0").toPandas()
        for block, rows_ in options.groupby("block_no"):
            plan = pd.DataFrame([(r.column_name, r.codec, r.byte_num) for r in got[block]], columns=["column_name", "codec", "byte_num"])
            need = rows_.groupby("column_name")["ori_len"].first()
            assert plan.groupby("column_name")["byte_num"].sum().to_dict() == need.to_dict()
            assert not plan.duplicated(["column_name", "codec"]).any()
            if need.sum() < planner.LEAST:
                assert set(plan["codec"]) == {151}
                continue
            want, said = planner.allocate(rows_, bandwidth, busy, target)
            assert {(r.status, r.switched) for r in got[block]} == {(said["status"], said["switched"])}
            if said["status"]:
                routes.add("none")
                continue
            assert np.isclose(got[block][0].objective, said["objective"], rtol=1e-7, atol=1e-12)
            used = plan.merge(rows_, on=["column_name", "codec"])
            pack, send = (used["byte_num"] / used["bw"]).sum(), (used["byte_num"] / (used["gain"] * bandwidth)).sum()
            slack = 1e-6 * (pack + send) + 10 * len(need) / bandwidth
            if said["switched"]:
                assert send <= target + slack and pack + busy * len(need) <= target + slack
                assert np.isclose(send + pack + busy * len(need), said["second"], rtol=1e-6, atol=slack)
                routes.add("second")
            else:
                assert pack <= send - busy + slack and np.isclose(send, said["objective"], rtol=1e-6, atol=slack)
                routes.add("split" if len(used) > len(need) else "first")
    assert routes == {"none", "second", "split", "first"}


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_islands_of_one_hot_file(spark, ranges):
    rng = random.Random(ranges)
    rows, kind = [], None
    for i in range(3000):
        kind = rng.choice([kind] * 40 + [True, False, None])
        rows.append(("hot" if i < 2900 else None if i < 2950 else "b", i, kind))
    df = spark.createDataFrame(rows, "file string, n long, c boolean").repartition(8)
    got = sorted(((r.file, r.island, r["class"], r.n_packets) for r in blocks.class_islands(df, F.col("c"), ["file"], ["n"], ranges).collect()), key=str)
    want = []
    for file in ("hot", None, "b"):
        island, before = 0, "none"
        for f, _, c in rows:
            if f == file:
                if c is not before:
                    island, before = island + 1, c
                    want.append([file, island, c, 0])
                want[-1][3] += 1
    assert got == sorted(map(tuple, want), key=str)
    if ranges > 1:
        sizes = [r["count"] for r in blocks._parted(df, ["n"], ranges).groupBy("file", "_part").count().collect()]
        assert max(sizes) < 3 * 3000 / ranges


def test_completion_of_one_stream_by_ranges(spark):
    df = spark.range(2000).select(F.lit(0).alias("stream"), F.col("id").alias("n"), (F.col("id") % 7).alias("ori_len"))
    out = transport.completed(df, ["stream"], ["n"], F.lit(5000)).orderBy("n").collect()
    total = 0
    for r in out:
        total += r.n % 7
        assert (r.received, r.done) == (total, total >= 5000)


def test_packets_are_placed_by_ranges(spark):
    rows = [(f, i, (i * 7 + len(f)) % 13) for f in ("a", "hot") for i in range(50 if f == "a" else 900)]
    df = spark.createDataFrame(rows, "file string, n long, size long").repartition(8)
    at = {"a": 0, "hot": 0}
    for r in blocks.packet_offsets(df, F.col("size"), ["file"], ["n"]).orderBy("file", "n").collect():
        assert (r.packet_len, r.offset) == (r.size, at[r.file])
        at[r.file] += r.size
    islands = blocks.class_islands(df, F.col("n") >= 20, ["file"], ["n"]).orderBy("file", "island").collect()
    assert [(r.file, r.island, r["class"], r.n_packets) for r in islands] == [("a", 1, False, 20), ("a", 2, True, 30), ("hot", 1, False, 20), ("hot", 2, True, 880)]
