"""Mixing against plain versions of the apportionment and of the targets."""

import heapq
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from colsync.llm import mixing
from colsync.llm.queries import op3_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def plain_seats(weights, seats, most):
    got = [0] * len(weights)
    heap = [(-w, i) for i, w in enumerate(weights) if w > 0 and most[i] > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        seats -= 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def test_sainte_lague_by_heap():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 12)
        w = [rng.choice([0, 1, 2, 5, rng.randint(1, 1000)]) for _ in range(n)]
        most = [rng.randint(0, 60) for _ in range(n)]
        seats = rng.randint(0, 300)
        assert mixing.sainte_lague(np.array(w), seats, np.array(most)).tolist() == plain_seats(w, seats, most)


def plain_targets(sizes, weights):
    left, out, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 3 * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i] = 3 * sizes[i]
            left -= 3 * sizes[i]
            open_.discard(i)
    return out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    total = defaultdict(int)
    for k, s in source.items():
        total[s] += size[k]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, plain_targets([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    rows = op3_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(size)
    taken = defaultdict(int)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= max(2, 0.001 * want[s])
    assert sorted(map(tuple, op3_mixing(spark, SF).collect())) == sorted(map(tuple, rows))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 3)
    rows = [(i, "w " * i, "a", "x") for i in range(20)] + [(100, None, None, "x"), (101, "one two", None, "x"), (102, "", "", "x"), (None, "q q", "b", "x"), (103, "z " * 30000, "b", "x"), (103, "z " * 30000, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    out = mixing.mix_plan(df).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in out)
    by = {r.source: r for r in out}
    assert by[""].target == 0 and by[None].source_size == 2 and by["b"].source_size == 60002
    assert mixing.mix_plan(df.limit(0)).count() == 0


def test_small_source_reaches_its_target(spark):
    rows = [(i, "w " * 100, "big") for i in range(40)] + [(100, "w " * 5, "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = defaultdict(int)
    for r in mixing.mix_plan(df, weights=(1, 1), blocks=200).collect():
        assert r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert taken["small"] == 15


def test_small_sources_beside_billions_of_words(spark):
    sizes = {"a_big": [1_000_000 + 7 * i for i in range(5000)], "b_large": [200_000] * 9000, "c_mid": [100] * 200, "d_tiny": [100] * 20, "e_tiny": [1500], "f_nine": [3000] * 3, "g_none": [0, 0]}
    rows = [(k * 100_000 + i, s, n) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("u", mixing.seeded("doc_id", 7))
    want = dict(zip(sizes, plain_targets([sum(x) for x in sizes.values()], [(5, 2, 1)[i % 3] for i in range(len(sizes))]), strict=True))
    assert want["d_tiny"] == 6000 and want["e_tiny"] == 4500
    taken = defaultdict(int)
    for r in mixing.apportioned(sized).collect():
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= 0.01 * target, s


def test_clashing_columns(spark):
    names = ["_id", "_size", "_taken", "_same", "_pass", "_words", "_number", "row", "turn", "words", "size", "taken", "lot", "_Words", "n_chars", "_row"]
    text = [("one two three " * (i + 1)).strip() for i in range(12)]
    rows = [(i, t, "ab"[i % 2], *[777] * (len(names) - 2)) for i, t in enumerate(text)] + [(3, "same row " * 4, "a", *[777] * (len(names) - 2))] * 3
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names if n not in ("_Words", "n_chars")))
        out = mixing.mixed(df).collect()
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert out and out[0].__fields__ == df.columns
    assert all(v == 777 for r in out for k, v in r.asDict().items() if k not in ("doc_id", "text", "source"))
    assert all((text[r.doc_id] + " same row").find(r.text.split(" ")[0]) >= 0 for r in out)


def test_rows_without_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 20)
    rows = [(None, "w " * (i % 40), "a") for i in range(900)] + [(5, "w " * (i % 3), "a") for i in range(900)] + [(1000 + i, "w w w", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shards = []
    held = mixing._selected
    monkeypatch.setattr(mixing, "_selected", lambda dealt, *a: (shards.append(dealt), held(dealt, *a))[1])
    out = sorted(map(str, mixing.mix_plan(df).collect()))
    assert out == sorted(map(str, mixing.mix_plan(df.repartition(5)).collect())) and len(out) == 2100
    largest = shards[0].groupBy("source", "shard").count().agg({"count": "max"}).first()[0]
    assert largest < 60
