"""Chat formatting by quotation linking, in DataFrame operations only.

Lines that begin with ``>`` are quoted, to the level of as many marks.  Within a
block of quoted lines those of one level are a passage.  Passages are normalised
and hashed, whole and line by line, and joined to the hashes of what earlier
messages of the conversation say themselves: whole, by paragraph and by line.
The best link of the lowest quoted level gives the message that is replied to;
chains of replies are followed to their first message, and every message gets
its place in reply order and its text without quotes.

The join never pairs all equal texts.  For each quoted hash it looks for the
latest message before, in two steps: within a stretch of ``STRETCH`` turns by a
running maximum, and before that by the maxima of the stretches.  So a long
conversation, or a text that it repeats, is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsync.llm.store import Scratch

#: Turns that one window of the search for the latest message holds.
STRETCH = 256

#: The marks of a quoted line.  Groups repeat possessively, which Java does in a loop and not by recursion.
_MARKS = r"^[ \t]*((?:>[ \t]?)++)"


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def _parsed(text: Column) -> Column:
    """Every line with its number, level, what it says, and the block of quoted lines that it is in."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    return F.transform(lines, lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("says")))


def _own_text(text: Column) -> Column:
    """What the message says itself: the lines that are not quoted, without blank ones at its ends."""
    kept = F.transform(F.filter(_parsed(text), lambda x: x.level == 0), lambda x: x.says)
    # the end is looked for at the beginning of a run only, else long runs within take their square in time
    return F.regexp_replace(F.array_join(kept, "\n"), r"\A\s+|(?<!\s)\s+\z", "")


def _hashes(texts: Column) -> Column:
    """Distinct hashes of the texts that have any characters once normalised."""
    return F.array_distinct(F.transform(F.filter(F.transform(texts, normalised), lambda x: x != ""), lambda x: F.xxhash64(x)))


def _said(own: Column) -> Column:
    """Hashes under which a message can be quoted."""
    return _hashes(F.concat(F.array(own), F.split(own, r"\n\s*\n", -1), F.split(own, "\n", -1)))


def _passages(text: Column) -> Column:
    """Quoted passages, with repeats: ``level, part, hash``; part 0 is the whole passage and part 1 one of its lines."""
    blocks = F.regexp_extract_all(F.regexp_replace(text, "\r\n?", "\n"), F.lit(r"(?m)(?:^[ \t]*>[^\n]*(?:\n|\z))++"), F.lit(0))

    def of_lines(lines: Column) -> Column:
        levels = F.array_distinct(F.transform(lines, lambda x: x.level))
        whole = F.transform(levels, lambda level: F.struct(level.alias("level"), F.lit(0).alias("part"), normalised(F.array_join(F.transform(F.filter(lines, lambda x: x.level == level), lambda x: x.says), " ")).alias("text")))
        single = F.transform(lines, lambda x: F.struct(x.level.alias("level"), F.lit(1).alias("part"), normalised(x.says).alias("text")))
        return F.filter(F.concat(whole, single), lambda x: x.text != "")

    def of_block(block: Column) -> Column:
        # the lines as a lambda's variable, so that they are parsed once and not for each level
        return F.flatten(F.transform(F.array(F.filter(_parsed(block), lambda x: x.level > 0)), of_lines))

    found = F.flatten(F.transform(blocks, of_block))
    return F.transform(found, lambda x: F.struct(x.level.alias("level"), x.part.alias("part"), F.xxhash64(x.text).alias("hash")))


def latest_before(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """For each ``conv_id, hash, turn`` of ``quotes`` the latest turn of ``said`` before it, as ``found``."""
    keys = quotes.select("conv_id", "hash").distinct()
    there = said.join(keys, ["conv_id", "hash"], "left_semi").select("conv_id", "hash", "turn", F.col("turn").alias("at")).distinct()
    both = quotes.select("conv_id", "hash", "turn", F.lit(None).cast("long").alias("at")).distinct().unionByName(there).withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    # at one turn the quotes come first, so they see only earlier messages
    near = Window.partitionBy("conv_id", "hash", "stretch").orderBy("turn", F.col("at").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id", "hash").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = both.groupBy("conv_id", "hash", "stretch").agg(F.max("at").alias("_top")).withColumn("_far", F.max("_top").over(before)).drop("_top")
    seen = both.withColumn("_near", F.max("at").over(near)).where("at IS NULL").join(stretches, ["conv_id", "hash", "stretch"])
    return seen.select("conv_id", "hash", "turn", F.coalesce("_near", "_far").alias("found")).where("found IS NOT NULL")


def _roots(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, turn, root, depth`` of every message with a parent, by doubling the steps until none leads on."""
    steps = scratch.put(parents.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "steps")
    while True:
        onward = steps.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        if steps.join(onward, ["conv_id", "root"], "left_semi").isEmpty():
            return steps
        joined = steps.join(onward, ["conv_id", "root"], "left")
        steps = scratch.put(joined.select("conv_id", "turn", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "steps")


def link_quotations(messages: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, role, content, n_quotes, max_level, n_linked, reply_to, root_turn, depth``.

    ``content`` is the message without quoted lines, ``n_quotes`` the number of
    distinct quoted passages (one for each block and level), ``n_linked`` how
    many of their hashes, lines included, an earlier message says.  ``reply_to``
    is the turn that the message answers: of the lowest linked level the whole
    passage before a line, then the latest turn; null without a link.  Replies
    follow chains to ``root_turn``, ``depth`` steps away; a message without a
    link is its own root at depth 0.  Sorted by ``conv_id, root_turn, depth,
    turn``, a conversation is in reply order.

    Null and empty texts say nothing and quote nothing.  A null ``conv_id`` or
    ``turn`` is never linked.  Messages that repeat a turn are rows of their own
    and one message for links.  Very long messages are parsed whole, in time
    linear in their length.  Ids and turns are whole numbers.  Other columns are
    not read; an empty table gives none.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    text = F.coalesce(F.col("text"), F.lit(""))
    conv, turn = F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")
    linkable = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = linkable.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    quotes = scratch.put(quoting.select(conv, turn, F.explode(_passages(text)).alias("q")).select("conv_id", "turn", "q.*").distinct(), "quotes")
    said = linkable.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi").select(conv, turn, F.explode(_said(_own_text(text))).alias("hash"))
    links = quotes.join(latest_before(quotes, said), ["conv_id", "hash", "turn"])
    best = links.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "part", (-F.col("found")).alias("back"))).alias("b"), F.count("*").alias("n_linked"))
    parents = scratch.put(best.select("conv_id", "turn", "n_linked", (-F.col("b.back")).alias("parent")), "parents")
    linked = _roots(parents, scratch).join(parents, ["conv_id", "turn"]).select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "parent", "root", "depth", "n_linked")
    own = messages.select(conv, turn, "role", _own_text(text).alias("content"), _passages(text).alias("_q"))
    whole = F.array_distinct(F.transform(F.filter("_q", lambda q: q.part == 0), lambda q: F.xxhash64(q.level, q.hash)))
    rows = own.select("conv_id", "turn", "role", "content", F.size(whole).cast("long").alias("n_quotes"), F.coalesce(F.array_max(F.transform("_q", lambda q: q.level)), F.lit(0)).cast("long").alias("max_level"))
    found = rows.join(linked, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    zero = F.lit(0).cast("long")
    return found.select("conv_id", "turn", "role", "content", "n_quotes", "max_level", F.coalesce("n_linked", zero).alias("n_linked"), F.col("parent").alias("reply_to"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", zero).alias("depth"))
