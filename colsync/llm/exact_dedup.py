"""Exact duplicates by two-pass Bloom filtering.

Pass one counts, for every row, the slots that the row's hash takes in a Bloom
filter; a slot that two rows take becomes a set bit.  Only slot numbers are
exchanged, summed on the map side first.  A row can have a copy only if all its
slots are set.  In pass two rows with an unset slot go straight to the output:
they are unique, and nothing of them is shuffled.  The others are grouped by the
SHA-256 of their text, which decides; a false positive of the filter ends up as
a group of one.

The filter has ``BITS_PER_ROW`` bits a row, however many rows there are, in
blocks; a hash has all its slots in one block.  Blocks are broadcast up to
``MAX_BROADCAST_BLOCKS``.  A larger filter stays in parts: the digests of the
rows, not their texts, are dealt to the blocks.  Texts are read once, and what
is read again are digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsync.llm.skew import MAX_BROADCAST_IDS, fresh, join_groups
from colsync.llm.store import Scratch

BITS_PER_ROW = 16
#: Slots of each row, each from its own part of the hash.
SLOTS = 2
#: Bits of a block: what ``bitmap_construct_agg`` makes; it takes ``_SLOT_BITS`` bits of the hash to name one.
_BLOCK, _SLOT_BITS = 32768, 15
#: Blocks that may be broadcast, 4 KB each: 32 MB.
MAX_BROADCAST_BLOCKS = 1 << 13


def filter_blocks(n_rows: int) -> int:
    """Blocks of the filter for so many rows: a power of two with ``BITS_PER_ROW`` bits a row or more."""
    return 1 << max(0, -(-n_rows * BITS_PER_ROW // _BLOCK) - 1).bit_length()


def _block(hashed: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, SLOTS * _SLOT_BITS), F.lit(blocks))


def _slot(hashed: Column, k: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, k * _SLOT_BITS), F.lit(_BLOCK))


def repeated_slots(hashes: DataFrame, blocks: int) -> DataFrame:
    """The filter: for each block a bitmap of the slots that two rows or more take, ``block, bitmap``."""
    slots = hashes.select(_block(F.col("h"), blocks).alias("block"), F.explode(F.array_distinct(F.array(*[_slot(F.col("h"), k) for k in range(SLOTS)]))).alias("slot"))
    twice = slots.groupBy("block", "slot").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg("slot").alias("bitmap"))


def _is_set(bitmap: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(slot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("bit_get", byte, (slot % 8).cast("int")) == 1


def possibly_repeated(rows: DataFrame, blocks: int, filled: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false only if no other row can have the same hash ``h``."""
    held = filled.select(F.col("block").alias("_block"), "bitmap")
    if blocks <= MAX_BROADCAST_BLOCKS:
        held = F.broadcast(held)
    found = rows.join(held, _block(F.col("h"), blocks) == F.col("_block"), "left")
    flag = F.col("bitmap").isNotNull()
    for k in range(SLOTS):
        flag = flag & _is_set(F.col("bitmap"), _slot(F.col("h"), k))
    return found.select(*rows.columns, F.coalesce(flag, F.lit(False)).alias("maybe"))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; a null text counts as empty.  The row with
    the largest id of a group stays, and of several rows with that id one; a null
    id is never chosen while the group has another.  Very long texts are hashed whole.  An empty table
    gives an empty result; other columns are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = _text(text_col)
    # written rows keep their number, which tells rows of one id and text apart
    rows = scratch.put(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row")), "digests")
    total = rows.count()
    blocks = filter_blocks(total)
    filled = scratch.put(repeated_slots(rows.select("h"), blocks), "filter")
    flagged = possibly_repeated(rows, blocks, filled)
    digest = F.lower(F.hex("sha")).alias("text_sha256")
    alone = flagged.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest)
    maybe = scratch.put(flagged.where("maybe").select("doc_id", "sha", "row"), "maybe")
    groups = scratch.put(maybe.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("_keep"), F.count("*").alias("group_size")).select("sha", "_keep.doc_id", "_keep.row", "group_size").toDF("sha", "keep_id", "keep_row", "group_size"), "groups")
    found = join_groups(maybe, groups, "sha", "group_size", total)
    return alone.unionByName(found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), digest))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: the one with the largest id of each text.

    As in ``exact_duplicates``, one of rows that repeat both the largest id and
    the text stays, a null id only where its text has no other.  Other columns
    may have any name; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    a, b, c = (fresh(docs.columns, n) for n in ("_id", "_sha", "_again"))
    # a row that goes beside one of its id and text that stays: these rows are listed and one of them is taken
    again = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    listed = exact_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(a), F.col("text_sha256").alias(b), again.alias(c)).distinct()
    listed = scratch.put(listed, "gone")
    few = listed.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    key = docs[f"`{id_col}`"].eqNullSafe(F.col(a)) & (F.sha2(_text(text_col), 256) == F.col(b))
    columns = [F.col(f"`{name}`") for name in docs.columns]
    kept = docs.join(F.broadcast(listed) if few else listed, key, "left_anti")
    several = listed.where(F.col(c))
    if several.isEmpty():
        return kept
    rows = docs.join(F.broadcast(several) if few else several, key)
    one = rows.groupBy(a, b).agg(F.first(F.struct(*columns)).alias(c))
    return kept.unionByName(one.select(*[F.col(c)[name].alias(name) for name in docs.columns]))
