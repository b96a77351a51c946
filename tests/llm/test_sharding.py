"""Extendible hashing against splitting one bucket after the other."""

import hashlib
from collections import defaultdict

import duckdb
import pytest

from colsync.llm import sharding
from colsync.llm.queries import ORACLES

SF = "/root/testdata/sf0.01"


def bits(doc_id):
    return f"{int(hashlib.md5(str('' if doc_id is None else doc_id).encode()).hexdigest()[:15], 16):060b}"


def plain(rows, limit):
    """Each document's shard by splitting oversized buckets until none is left."""
    out, todo = {}, [("", rows)] if rows else []
    while todo:
        prefix, held = todo.pop()
        total = sum(s for _, s in held)
        if total > limit and len(held) > 1 and len(prefix) < sharding.HASH_BITS:
            parts = defaultdict(list)
            for r in held:
                parts[bits(r[0])[len(prefix)]].append(r)
            todo += [(prefix + b, p) for b, p in parts.items()]
        else:
            for r in held:
                out[r[0]] = (prefix or "root", len(prefix), len(held), total, total <= limit)
    return out


@pytest.mark.parametrize("limit,level", [(sharding.SHARD_BYTES, 12), (50_000, 12), (3_000, 12), (20_000, 4)])
def test_whole_table(spark, monkeypatch, limit, level):
    monkeypatch.setattr(sharding, "LEVEL_BITS", level)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([(r.doc_id, len((r.text or "").encode())) for r in docs.collect()], limit)
    got = sharding.assign_shards(docs, limit=limit).collect()
    assert {r.doc_id: (r.shard, r.depth, r.shard_docs, r.shard_bytes, r.fits) for r in got} == want
    assert len(got) == len(want)
    assert all(r.fits or r.shard_docs == 1 for r in got)


def test_oracle_with_small_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.execute(ORACLES["op10_sharding"].replace(str(sharding.SHARD_BYTES), "40000"))
    names = [c[0] for c in rel.description]
    assert sorted(rel.fetchall()) == sorted(tuple(r[n] for n in names) for r in sharding.assign_shards(docs, limit=40_000).collect())


def test_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_BROADCAST", 2)
    rows = [(i, "x" * (i % 7 * 10), i, "keep") for i in range(300)] + [(1000, "y" * 100_000, 1, "k"), (1001, None, 2, "k"), (1002, "", 3, "k"), (None, "é" * 50, 4, "k")] + [(7777, "z" * 90, 5, "same")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long, shard string")
    out = sharding.assign_shards(df, limit=400, keep=True)
    assert out.columns == ["doc_id", "n_bytes", "shard", "depth", "shard_docs", "shard_bytes", "fits", "text", "n_bytes_", "shard_"]
    got = out.collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.shard, r.depth, r.shard_docs, r.shard_bytes, r.fits) for r in got} == plain([(a, len((t or "").encode())) for a, t, _, _ in rows], 400)
    assert {r.doc_id for r in got if not r.fits} == {1000, 7777}
    sharding.write_shards(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert sharding.assign_shards(df.limit(0), limit=400).count() == 0


def test_clashing_columns(spark):
    names = ["_depth", "_prefix", "_entry", "_bits", "bits", "bytes", "row", "bucket", "prefix", "n", "entry12", "bucket12", "col1", "_none", "i"]
    df = spark.createDataFrame([(k, "x" * k, *[777] * len(names)) for k in range(90)], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    out = sharding.assign_shards(df, limit=300, keep=True)
    assert set(out.columns) == {*sharding._RESULT, "text", *names}
    got = out.collect()
    assert {r.doc_id: (r.shard, r.depth, r.shard_docs, r.shard_bytes, r.fits) for r in got} == plain([(k, k) for k in range(90)], 300)
    assert all(r[n] == 777 for r in got for n in names) and all(len(r.text) == r.doc_id for r in got)


def test_clashing_columns_stay(spark):
    names = ["shard", "depth", "n_bytes", "Shard_docs", "shard_bytes", "fits", "fits_", "row", "bits"]
    df = spark.createDataFrame([(i, "x" * i, *[777] * len(names), {"k": i}) for i in range(30)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names) + ", tags map<string,long>")
    out = sharding.assign_shards(df, limit=60, keep=True)
    rows = out.collect()
    assert len(rows) == 30 and out.columns[:7] == ["doc_id", "n_bytes", "shard", "depth", "shard_docs", "shard_bytes", "fits"]
    assert out.columns[7:] == ["text", "shard_", "depth_", "n_bytes_", "Shard_docs_", "shard_bytes_", "fits__", "fits_", "row", "bits", "tags"]
    assert all(r[n] == 777 for r in rows for n in out.columns[8:-1]) and all(r.tags == {"k": r.doc_id} for r in rows)
    plainly = {r.doc_id: tuple(r)[1:] for r in sharding.assign_shards(df, limit=60).collect()}
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == plainly
