"""Filter interaction audit by lattice edges.

Filters may be applied in any order.  What a filter removes depends only on the
set of filters before it, so all orders are paths through the lattice of
subsets, and a step of an order is an edge: (already applied subset, next
filter).  Five filters have 80 edges and 120 orders of 600 steps.

Each document becomes a mask of the filters that it fails.  Equal masks of a
part are counted together, the counts contribute to every edge, and the summed
edges are joined to the steps.  Documents never meet the orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsync.llm.skew import join_groups
from colsync.llm.store import Scratch

#: Failure conditions in words: short, repeated words, capitals, symbols, copy of a document with a smaller id.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
#: Orders of more filters than this are too many to list: 8 filters have 322,560 steps.
MAX_FILTERS = 8


def text_failures(text: Column) -> Column:
    """The filters A to D that a whole text fails, as bits from the lowest."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    n = F.size(words).cast("long")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    failed = [
        n < MIN_WORDS,
        F.size(F.array_distinct(words)).cast("long") * 100 < n * MIN_DISTINCT_PERCENT,
        capitals * 100 > F.char_length(text).cast("long") * MAX_CAPITAL_PERCENT,
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))


def edges(names: str) -> list[tuple[int, int]]:
    """All (applied subset, next filter) as bit masks: ``k * 2**(k - 1)`` for k filters."""
    bits = [1 << i for i in range(len(names))]
    return [(s, b) for b in bits for s in range(1 << len(names)) if not s & b]


def steps(names: str) -> list[tuple[str, int, int, int]]:
    """Each step of each order: ``filter_order, step, applied, next``."""
    out = []
    for order in permutations(range(len(names))):
        applied = 0
        for at, i in enumerate(order):
            out.append(("".join(names[k] for k in order), at + 1, applied, 1 << i))
            applied |= 1 << i
    return out


def audit_masks(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """All steps of all orders from ``part, mask, good, toxic, n``: counts of documents by the filters that they fail.

    ``mask`` has a bit for each letter of ``names``, which may be any letters,
    ``MAX_FILTERS`` at most.  A part without documents has no rows, one with
    some has all steps.  Rows of equal part and mask add up.
    """
    if not 0 < len(set(names)) == len(names) <= MAX_FILTERS:
        raise ValueError(f"one to {MAX_FILTERS} different letters name the filters")
    spark = cells.sparkSession
    edge = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(b).alias("next")) for s, b in edges(names)])
    at = cells.select("part", "mask", "good", "toxic", "n", F.explode(edge).alias("e")).select("*", "e.applied", "e.next")
    before, fails = F.col("mask").bitwiseAND(F.col("applied")) != 0, F.col("mask").bitwiseAND(F.col("next")) != 0
    removed = fails & ~before
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long").alias(name)
    summed = at.groupBy("part", "applied", "next").agg(
        total(~before & ~fails, "kept"), total(removed, "removed"), total(before & fails, "redundant"), total(F.col("mask") == F.col("next"), "unique_fails"),
        total(removed & F.col("good"), "good_lost"), total(removed & F.col("toxic"), "toxic_lost"),
    )
    # the number of steps is fixed by the number of filters
    paths = F.broadcast(spark.createDataFrame(steps(names), "filter_order string, step int, applied int, next int"))
    walked = summed.join(paths, ["applied", "next"])
    shapley = walked.groupBy("part", "next").agg(F.sum("removed").cast("long").alias("shapley"))
    return walked.join(shapley, ["part", "next"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents by part, failed filters and labels: ``part, mask, good, toxic, n``; texts are read once.

    What goes on from a text is its digest and its mask.  Copies are found by
    SHA-256; groups with many rows are joined as a broadcast of fewer than a
    thousand.  Rows that repeat an id are counted together before they meet
    their labels, so an id with very many rows fills no task.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = scratch.put(read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), text_failures(F.col("text")).alias("mask")), "rows")
    groups = scratch.put(rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    found = join_groups(rows, groups, "sha", "copies", rows.count(), "left")
    copied = F.when(F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)), 1 << 4).otherwise(0)
    counted = found.groupBy("doc_id", "part", (F.col("mask") + copied).alias("mask")).agg(F.count("*").alias("n"))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).where("good OR toxic")
    marked = counted.join(known, F.col("doc_id") == F.col("_id"), "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return marked.groupBy("part", "mask", flag("good"), flag("toxic")).agg(F.sum("n").cast("long").alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each step of each order of the five filters, by language: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Null and empty texts have no words, characters or symbols: they fail A, and
    E where a smaller id is as empty.  Very long texts are read whole.  Rows that repeat
    an id and a text are both first; a null id is neither a copy nor has a label.
    Of several labels of an id any that is 1 counts.  A null language is the
    part '' together with an empty one.  An empty table gives no rows; other
    columns are not read.
    """
    return audit_masks(failure_cells(docs, labels))
