"""Sharding by extendible hashing.

A document's key is hashed; a directory indexed by leading hash bits says which
bucket it falls into.  All begin in one bucket of no bits.  A bucket over the
byte limit splits in two on its next bit, and only such buckets split, until
every bucket fits or holds nothing that another bit could part: a single
document above the limit, or rows with one and the same key.

The directory is grown from byte counts by hash prefix.  ``LEVEL_BITS`` bits are
counted at a time, summed on the map side; the next bits are counted only under
prefixes that are still too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsync.llm.skew import fresh
from colsync.llm.store import Scratch

#: Bytes of text that a shard may hold.
SHARD_BYTES = 16 << 20
#: Bits of the hash; beyond these nothing can be told apart.
HASH_BITS = 60
#: Bits that one round of counting adds.
LEVEL_BITS = 12
#: Entries of one level of the directory that may be broadcast, about 64 bytes each; a larger level is shuffled.
MAX_BROADCAST = 1 << 18


def hash_bits(key: Column) -> Column:
    """The leading ``HASH_BITS`` bits of the key's MD5 as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def _splits(limit: int) -> Column:
    return (F.col("bytes") > limit) & (F.col("n") > 1)


def _grow(counts: DataFrame, depth: int, deeper: int, limit: int) -> DataFrame:
    """Buckets of depth ``depth + 1`` to ``deeper`` below those of ``depth`` bits that have to split.

    ``counts`` has ``bits`` of length ``deeper``, ``n`` and ``bytes``; each row
    adds to all its prefixes.  A bucket is in the directory when its parent had
    to split and it has not; at ``deeper`` those that still have to are there too.
    """
    prefixes = counts.select(F.explode(F.sequence(F.lit(depth), F.lit(deeper))).alias("depth"), "bits", "n", "bytes")
    sums = prefixes.groupBy("depth", F.expr("substring(bits, 1, depth)").alias("prefix")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    parent = sums.where(_splits(limit)).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_parent"))
    held = sums.where(F.col("depth") > depth).withColumn("_parent", F.expr("substring(prefix, 1, depth - 1)"))
    return held.join(parent, ["depth", "_parent"], "left_semi").where(~_splits(limit) | (F.col("depth") == deeper)).select("prefix", F.col("depth").cast("int").alias("depth"), "n", "bytes")


def directory(sized: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """The buckets: ``prefix, depth, n, bytes``; ``sized`` has ``bits`` and ``bytes`` of each document."""
    count = lambda rows, depth: scratch.put(rows.groupBy(F.substring("bits", 1, depth).alias("bits")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "counts")
    depth = LEVEL_BITS
    counts = count(sized, depth)
    root = counts.agg(F.lit("").alias("prefix"), F.lit(0).alias("depth"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    found = scratch.put(root.where(~_splits(limit) & (F.col("n") > 0)).unionByName(_grow(counts, 0, depth, limit)), "buckets")
    done = found
    while depth < HASH_BITS:
        large = found.where((F.col("depth") == depth) & _splits(limit))
        if large.isEmpty():
            break
        under = sized.withColumn("prefix", F.substring("bits", 1, depth)).join(large.select("prefix"), "prefix", "left_semi")
        done = done.join(large.select("prefix", "depth"), ["prefix", "depth"], "left_anti")
        counts = count(under, depth + LEVEL_BITS)
        found = scratch.put(_grow(counts, depth, depth + LEVEL_BITS, limit), "buckets")
        done = done.unionByName(found)
        depth += LEVEL_BITS
    return scratch.put(done.select("prefix", "depth", "n", "bytes"), "directory")


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES, keep: bool = False) -> DataFrame:
    """One row per document with its shard: ``doc_id, n_bytes, shard, depth, shard_docs, shard_bytes, fits``.

    ``shard`` is the hash prefix of the bucket in bits (``root`` for the bucket
    of no bits).  ``n_bytes`` is the length of the text in UTF-8, 0 for null.
    ``fits`` is false only for buckets that no bit can part: one document over
    the limit, or rows that repeat one id and are too large together.  Null ids
    hash like an empty string; rows that repeat an id are rows of their own.  A
    very long text is a number here.  ``keep`` also returns the columns of
    ``docs``, whatever their names: one with a name from above goes on under
    that name with ``_`` behind it.  An empty table has no shards.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    key, size = F.col(f"`{id_col}`"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    extra = [c for c in docs.columns if c != id_col] if keep else []
    read = docs.select(key.alias("doc_id"), hash_bits(key).alias("bits"), size.alias("bytes"), F.struct(F.lit(0).alias(fresh(extra, "_none")), *[F.col(f"`{c}`") for c in extra]).alias("row"))
    # ids and sizes only: a few bytes a document
    sized = scratch.put(read.drop("row"), "sized")
    buckets = directory(sized, limit, scratch)
    found = read if keep else sized
    levels = [r["level"] for r in buckets.select((F.greatest(F.ceil(F.col("depth") / LEVEL_BITS), F.lit(1)) * LEVEL_BITS).cast("int").alias("level")).distinct().orderBy("level").collect()]
    for level in levels:
        # a row has one bucket; deeper levels have entries only under prefixes that split
        held = buckets.where((F.col("depth") <= level) & (F.col("depth") > (level - LEVEL_BITS if level > LEVEL_BITS else -1)))
        entries = _entries(held, level).select(F.col("entry").alias(f"entry{level}"), F.struct("prefix", "depth", "n", "bytes").alias(f"bucket{level}"))
        if entries.count() <= MAX_BROADCAST:
            entries = F.broadcast(entries)
        found = found.join(entries, F.substring("bits", 1, level) == F.col(f"entry{level}"), "left")
    bucket = F.coalesce(*[F.col(f"bucket{x}") for x in levels]) if levels else F.lit(None).cast("struct<prefix:string,depth:int,n:long,bytes:long>")
    found = found.withColumn("bucket", bucket)
    name = F.when(F.col("bucket.depth") == 0, F.lit("root")).otherwise(F.col("bucket.prefix"))
    made = [F.col("bytes"), name, F.col("bucket.depth"), F.col("bucket.n"), F.col("bucket.bytes"), F.col("bucket.bytes") <= limit]
    return found.select("doc_id", *[c.alias(n) for c, n in zip(made, _RESULT[1:], strict=True)], *[F.col(f"row.`{c}`").alias(n) for c, n in _kept_names(extra).items()])


_RESULT = ("doc_id", "n_bytes", "shard", "depth", "shard_docs", "shard_bytes", "fits")


def _kept_names(columns: list[str]) -> dict[str, str]:
    """A name for each column that is none of the result's and no other column's, whatever the case: its own, if that is free."""
    taken, out = {n.lower() for n in (*_RESULT, *columns)}, {}
    for c in columns:
        name = c
        if c.lower() in _RESULT:
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        out[c] = name
    return out


def _entries(buckets: DataFrame, depth: int) -> DataFrame:
    """The directory at ``depth`` bits: an ``entry`` for each prefix of that length that a bucket covers."""
    tail = F.expr(f"lpad(conv(i, 10, 2), {depth} - depth, '0')")
    spread = buckets.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, {depth} - depth) - 1"))))
    return spread.withColumn("entry", F.concat("prefix", F.when(F.col("depth") < depth, tail).otherwise(F.lit(""))))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write the result of ``assign_shards(keep=True)`` as Parquet, a folder for each shard.

    Rows go to writers by shard, so a shard is one file unless AQE splits it.
    """
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)
