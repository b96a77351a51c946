"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is dealt in blocks of equal token counts.  Sources get whole numbers of
blocks by highest quotients ``target / (2 * seats + 1)``; then the blocks of a
source are dealt to its shards the same way, by shard size.  Within a shard the
documents are laid end to end in seeded order and cut into blocks; a shard with
more blocks to give than it has starts over, so parts of it repeat.

A shard is a hash range of a source, of about ``SHARD_DOCS`` documents; a
larger source has more shards, up to ``MAX_SHARDS``, so that neither a window
nor the list of a source's shards is long.  Blocks are short beside the target
of the smallest source and beside the shards, so rounding to whole blocks costs
no source more than about a hundredth of its target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsync.llm.skew import fresh, row_columns
from colsync.llm.store import Scratch
from colsync.llm.words import NOT_SPACE, word_counts, word_slices

#: Base weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its own size.
MAX_REPEATS = 3
#: Blocks of the whole mix, of the smallest target and of a source's mean shard, at least, as long as a block has a word.
BLOCKS, TARGET_BLOCKS, SHARD_BLOCKS = 1 << 20, 100, 64
#: Documents of a shard, about, and shards of a source at most.
SHARD_DOCS, MAX_SHARDS = 4096, 1 << 16
SEED = 7
#: Plan rows of one repeated row that are given its text together.
LOT = 1000
#: Sources whose totals the driver works on: one short row each.
MAX_SOURCES = 1_000_000


def targets(sizes: np.ndarray, weights: np.ndarray, total: float | None = None, most: float = MAX_REPEATS) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess goes to the others by weight.

    ``total`` is the sum of all sizes unless given.  Where all sources are at their most, the rest is left out.
    """
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    total = sizes.sum() if total is None else float(total)
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        left = total - most * sizes[~open_].sum()
        share = left * weights / weights[open_].sum()
        over = open_ & (share > most * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        open_ &= ~over
        out[over] = most * sizes[over]
    return out


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients ``w / (2 s + 1)``, at most ``most[i]`` each; ties go to the earlier entry.

    The quotient of the last seat is found by bisection, so time doesn't grow with ``seats``.
    """
    w = np.asarray(weights, float)
    cap = np.full(len(w), seats, np.int64) if most is None else np.minimum(np.asarray(most, np.int64), seats)
    cap = np.where(w > 0, cap, 0)
    seats = min(int(seats), int(cap.sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)
    given = lambda level: np.minimum(np.floor(w / level / 2 + 0.5).astype(np.int64), cap)  # noqa: E731  quotients of level or more
    low, high = w[w > 0].min() / (4.0 * seats + 4), w.max() * 2
    for _ in range(200):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if given(mid).sum() >= seats else (low, mid)
    got = given(high)
    while (left := seats - int(got.sum())) > 0:
        quotient = np.where(got < cap, w / (2 * got + 1), -1.0)
        got[np.argsort(-quotient, kind="stable")[: min(left, int((got < cap).sum()))]] += 1
    return got


def block_words(target: np.ndarray, size: np.ndarray, shards: np.ndarray, blocks: int = BLOCKS) -> int:
    """Words of a block: few enough for the mix, for the smallest target and for the shards of each source."""
    there = (target > 0) & (size > 0)
    if not there.any():
        return 1
    return max(1, int(min(target.sum() // blocks, target[there].min() // TARGET_BLOCKS, (size[there] // shards[there]).min() // SHARD_BLOCKS)))


def _sized(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(word_counts(batch.column(2), NOT_SPACE)), *batch.columns[3:]], names=["doc_id", "source", "size", *batch.schema.names[3:]])


def seeded(id_col: str, seed: int, *more: str) -> Column:
    """A number of 60 bits for each id, from the MD5 of seed and id, and of further columns that tell rows of one id apart."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), *[F.concat(F.lit(":"), F.col(c).cast("string")) for c in more])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, weights: tuple = WEIGHTS, total: float | None = None, max_repeats: int = MAX_REPEATS, blocks: int = BLOCKS, keyed_rows: bool = False) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, quota_blocks, taken``.

    Sources are taken in the order of their code points, null last (a null
    source is a source of its own, apart from an empty one); their weights
    repeat.  ``size`` is the number of words of the whole text, 0 for null.
    ``taken`` counts the words that the mix takes from the document, repeats
    included; it is at most ``max_repeats * size``.  The seed, ids and sizes
    fix the result; rows that repeat an id, or have none, are seeded each by its
    size and a number within rows of that id, source and size, which are interchangeable.  An empty table gives an empty plan, a source without
    words a target of 0.  Ids are whole numbers; very long texts count whole,
    and other columns are not read.  With ``keyed_rows`` the documents are those of
    ``mixed``; the plan has their ``_same``, a ``_number`` within equal rows and
    how many those are, and rows that share an id, or have none, are seeded each
    by itself.
    """
    spark = docs.sparkSession
    row = ["_same"] if keyed_rows else []
    sized = docs.select(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string"), *row).mapInArrow(_sized, "doc_id long, source string, size long" + ", _same string" * keyed_rows)
    # ids, sources and sizes only: a few bytes a document, read three times below
    sized = Scratch(spark, "mix").put(sized.withColumn("_row", F.monotonically_increasing_id()))
    if keyed_rows:
        return apportioned(_numbered(sized).withColumn("u", seeded("doc_id", seed, "_same", "_number")), weights, total, max_repeats, blocks)
    # rows without an id, or with the same one, are told apart by their size and then by number
    numbered = _numbered(sized.withColumn("_same", F.to_json(F.struct("doc_id", "source", "size"))))
    keyed = numbered.withColumn("u", seeded("doc_id", seed, "size", "_number"))
    return apportioned(keyed, weights, total, max_repeats, blocks).drop("_same", "_number", "_copies")


def apportioned(keyed: DataFrame, weights: tuple = WEIGHTS, total: float | None = None, max_repeats: int = MAX_REPEATS, blocks: int = BLOCKS) -> DataFrame:
    """The plan for rows ``doc_id, source, size`` that are ordered by their number ``u``."""
    spark = keyed.sparkSession
    found = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rows = found.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    size = np.array([r["source_size"] for r in rows], float)
    target = targets(size, np.array([weights[i % len(weights)] for i in range(len(rows))], float), total, max_repeats)
    shards = np.array([max(1, min(MAX_SHARDS, -(-r["n"] // SHARD_DOCS))) for r in rows], np.int64)
    block = block_words(target, size, shards, blocks)
    quota = sainte_lague(target, int(round(target.sum() / block)))
    plan = pa.table(
        {
            "source": pa.array([r["source"] for r in rows], pa.string()),
            "source_size": pa.array([r["source_size"] for r in rows], pa.int64()),
            "target": pa.array(target, pa.float64()),
            "quota_blocks": pa.array(quota, pa.int64()),
            "shards": pa.array(shards, pa.int64()),
        }
    )
    plan = spark.createDataFrame(plan)
    # one short row for each source, MAX_SOURCES at most
    dealt = keyed.join(F.broadcast(plan), keyed["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    dealt = dealt.withColumn("shard", F.pmod("u", "shards"))
    return _selected(dealt, block, max_repeats).select("doc_id", "source", "size", "source_size", "target", "quota_blocks", "taken", *[c for c in ("_same", "_number", "_copies") if c in keyed.columns])


def _numbered(rows: DataFrame) -> DataFrame:
    """Written rows with ``_number``, counted from 0 within equal rows, and their number ``_copies``.

    The upper bits of ``_row`` name the task that wrote a row; no window holds more rows than one task wrote.
    """
    rows = rows.withColumn("_part", F.shiftrightunsigned("_row", 33))
    equal = Window.partitionBy("_same")
    before = F.sum("_n").over(equal.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("_same", "_part").agg(F.count("*").alias("_n")).select("_same", "_part", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_n").over(equal).alias("_copies"))
    within = F.row_number().over(Window.partitionBy("_same", "_part").orderBy("_row"))
    return rows.withColumn("_within", within).join(starts, ["_same", "_part"]).withColumn("_number", F.col("_start") + F.col("_within") - 1).drop("_part", "_start", "_within", "_row")


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``row, size, taken`` of ``rows`` (``_same, row``) by a written plan, each row once.

    Of equal rows one text is read and given to all their plan rows, in lots, so
    that no task makes all of them.  The plan is the side that is held; texts
    are shuffled, not sorted.
    """
    used = plan.where("taken > 0")
    once, several = used.where("_copies = 1").select("_same", "size", "taken"), used.where("_copies > 1").withColumn("lot", F.floor(F.col("_number") / LOT))
    found = rows.join(once.hint("shuffle_hash"), "_same").select("row", "size", "taken")
    if several.isEmpty():
        return found
    repeated = several.select("_same").distinct()
    one = rows.join(repeated.hint("shuffle_hash"), "_same", "left_semi").groupBy("_same").agg(F.first("row").alias("row"))
    lots = several.select("_same", "lot").distinct()
    return found.unionByName(one.join(lots, "_same").join(several, ["_same", "lot"]).select("row", "size", "taken"))


def _selected(dealt: DataFrame, block: int, max_repeats: int) -> DataFrame:
    """Deal the blocks of each source to its shards, and those of a shard to its documents in seeded order."""
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("quota_blocks").alias("quota_blocks"))
    return shards_to_docs(dealt, shard_quotas(shards, block, max_repeats), block, max_repeats)


def shard_quotas(shards: DataFrame, block: int, max_repeats: int) -> DataFrame:
    """Whole blocks for each shard of a source by Sainte-Lague on the shards' sizes: ``source, shard, shard_size, blocks``.

    One group is one source; it has a short row for each of its shards, ``MAX_SHARDS`` at most.
    """

    def deal(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("shard").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        size = table.column("shard_size").to_numpy()
        # rounded up: a shard's words are held to its own limit in the end
        most = -(-max_repeats * size // block)
        got = sainte_lague(size, int(table.column("quota_blocks")[0].as_py()), most)
        return pa.table({"source": table.column("source").cast(pa.string()), "shard": table.column("shard").cast(pa.int64()), "shard_size": pa.array(size, pa.int64()), "blocks": pa.array(got, pa.int64())})

    return shards.groupBy("source").applyInArrow(deal, "source string, shard long, shard_size long, blocks long")


def shards_to_docs(dealt: DataFrame, quotas: DataFrame, block: int, max_repeats: int) -> DataFrame:
    """``taken`` of each document: the whole passes over its shard, and its part of the blocks that are left."""
    q = quotas.select(F.col("source").alias("_s"), F.col("shard").alias("_n"), "shard_size", "blocks")
    joined = dealt.join(q, dealt["source"].eqNullSafe(q["_s"]) & (dealt["shard"] == q["_n"])).drop("_s", "_n")
    line = Window.partitionBy("source", "shard").orderBy("u", "doc_id", "size", *[c for c in ("_same", "_number") if c in dealt.columns]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("size").over(line)
    words = F.least(F.col("blocks") * block, F.col("shard_size") * max_repeats)
    passes = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0)
    left = words - passes * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - (F.col("_end") - F.col("size"))))
    return joined.withColumn("_end", end).withColumn("taken", (passes * F.col("size") + part).cast("long")).drop("_end")


def first_words(text: str, n: int) -> str:
    """The text up to the end of its ``n``-th word."""
    if n <= 0:
        return ""
    part = next(word_slices(pa.array([text], pa.string()), NOT_SPACE, lower=False))
    return part.data[: part.ends[min(n, len(part.ends)) - 1]].tobytes().decode("utf-8", "replace") if len(part.ends) else ""


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as ``mix_plan`` takes all its words, and once more cut to the words that are left.

    Documents of which nothing is taken are left out, those without words too;
    ``n_chars`` is that of the text as cut.  Rows are planned and joined by 128
    bits of hashes of all their columns and a number within equal rows, so ids
    may be null or repeat.  A very long text is cut whole in one task.  Other
    columns are carried along, whatever their names; an empty table gives none.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    same = F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(k), *row_columns(docs))) for k in (1, 2)])
    # the document as one field, so that its columns and those of the plan keep apart
    rows = docs.select(same.alias("_same"), F.struct(*columns).alias("row"))
    read = docs.select(same.alias("_same"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    plan = mix_plan(read, keyed_rows=True, **options).select("_same", "_number", "_copies", "size", "taken")
    rows = _planned(rows, Scratch(docs.sparkSession, "mix-plan").put(plan))
    whole = F.floor(F.col("taken") / F.col("size"))
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size"))))).withColumn("words", F.when(F.col("turn") > whole, F.col("taken") % F.col("size")))
    words = fresh(docs.columns, "_words")
    cut = rows.where("words IS NOT NULL").select("row.*", F.col("words").alias(words))
    place, width = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            texts = [first_words(t, n) for t, n in zip(batch.column(place).to_pylist(), batch.column(width).to_pylist(), strict=True)]
            made = [pa.array(texts, batch.schema.field(place).type) if i == place else batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays(made, names=batch.schema.names[:width])

    out = rows.where("words IS NULL").select("row.*").unionByName(cut.mapInArrow(run, docs.schema))
    return out.withColumn("n_chars", F.char_length(F.col(f"`{text_col}`")).cast("long")).select(*columns) if "n_chars" in docs.columns else out
