"""Exact dedup against groups by text, with a filter that is too small, hot groups and odd rows."""

import hashlib
from collections import defaultdict

import pytest

from colsync.llm import exact_dedup, skew
from colsync.llm.queries import op8_exact_dedup

SF = "/root/testdata/sf0.01"


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    stayed = set()
    for i, t in rows:
        held = groups[t or ""]
        keep = max((x for x in held if x is not None), default=None)
        out.append((i, keep, len(held), i == keep and (t or "") not in stayed, hashlib.sha256((t or "").encode()).hexdigest()))
        stayed |= {t or ""} if i == keep else set()
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(rows)
    assert got(op8_exact_dedup(spark, SF)) == want
    kept = exact_dedup.drop_exact_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, k, _ in sorted(want) if k]


@pytest.mark.parametrize("bits,broadcast,hot,few", [(16, 1 << 13, 1000, 1 << 20), (1, 1 << 13, 3, 1 << 20), (1 << 12, 1, 1000, 0), (0, 0, 1000, 0)])
def test_edges(spark, monkeypatch, bits, broadcast, hot, few):
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", bits)
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_BLOCKS", broadcast)
    if not bits:  # every slot is taken by many rows: all of them go to the shuffle
        monkeypatch.setattr(exact_dedup, "_BLOCK", 2)
    monkeypatch.setattr(skew, "HOT_SHARE", hot)
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_IDS", few)
    rows = [(i, "same text") for i in range(700)] + [(1000 + i, f"text {i % 900}") for i in range(1300)] + [(5000, None), (5001, ""), (5002, " "), (5003, "é" * 100_000), (5004, "é" * 100_000), (5005, "Same Text")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, keep_id string, h int")
    assert got(exact_dedup.exact_duplicates(df)) == plain(rows)
    odd = [(None, "a"), (None, "a"), (7, "a"), (7, "a"), (7, "a"), (3, "a"), (None, "b"), (None, "c"), (None, "c")] + [(9, "hot")] * 400 + [(2, "hot")] * 5
    twice = spark.createDataFrame(odd, "doc_id long, text string").repartition(3)
    assert got(exact_dedup.exact_duplicates(twice)) == plain(odd)
    assert sorted(map(str, map(tuple, exact_dedup.drop_exact_duplicates(twice).collect()))) == sorted(map(str, [(7, "a"), (None, "b"), (None, "c"), (9, "hot")]))
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k, _, _, _ in plain(rows) if i == k)
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_unique_rows_pass_straight_through(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.xxhash64("id").alias("h")).unionByName(spark.range(100).select(F.xxhash64("id").alias("h")))
    blocks = exact_dedup.filter_blocks(20_100)
    flagged = exact_dedup.possibly_repeated(rows, blocks, exact_dedup.repeated_slots(rows, blocks)).groupBy("maybe").count().collect()
    counts = {r["maybe"]: r["count"] for r in flagged}
    assert 200 <= counts[True] < 900


def test_filter_follows_the_rows():
    assert [exact_dedup.filter_blocks(n) for n in (0, 1, 2048, 2049, 10**6, 10**10)] == [1, 1, 1, 2, 512, 1 << 23]


def test_drop_with_repeated_and_null_ids_and_clashing_columns(spark):
    names = ["_id", "_sha", "_gone", "h", "maybe", "kept", "_ID_"]
    rows = [(7, "a"), (7, "a"), (7, "b"), (3, "a"), (None, "a"), (None, "b"), (None, "c"), (9, None), (8, "")]
    df = spark.createDataFrame([(i, t, *[777] * len(names)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    out = exact_dedup.drop_exact_duplicates(df)
    assert out.columns == df.columns and all(r[n] == 777 for r in out.collect() for n in names)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(7, "a"), (7, "b"), (None, "c"), (9, None)], key=str)
