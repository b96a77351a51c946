"""Secret scans with multipart credential linking, in DataFrame operations only.

Base patterns give spans that are always reported.  Weaker candidates, such as a
user name, an address or a long mixed token, mean little alone.  Each span has a
role: identifier, secret or endpoint.  An interval join pairs the weak
candidates of a text with the parts around them, at most ``SCOPE`` characters
away, and a candidate is reported only when parts that complement it are there:
one base part of another role, or weak parts of both other roles.

Spans are found with ``split`` and ``regexp_extract_all``: a match begins after
all pieces and matches before it, a running sum over the matches of a text.
The join is by text and by stretch of ``SCOPE`` characters, so a text with very
many parts is spread over many tasks and no candidate meets more parts than fit
around it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters between a weak candidate and a part that complements it, at most.
SCOPE = 200

_CHARS = "A-Za-z0-9+/_.=-"


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, what must be in a text that has one, and its role."""

    name: str
    role: str
    pattern: str
    gate: tuple[str, ...]
    #: The group that must have ``least`` characters.
    group: int = 0
    least: int = 0
    #: Patterns that must all be found in the match.
    has: tuple[str, ...] = ()
    base: bool = True


# No pattern repeats a group, which Java matches by recursion, and what may fail
# after a run of characters has a bound on the run; so time is linear in the text.
KINDS = (
    Kind("assign", "secret", rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([{_CHARS}]+)""", (":", "="), 1, 8),
    Kind("access", "identifier", r"AKIA[A-Z0-9]+", ("AKIA",), 0, 16),
    Kind("hex", "secret", r"[0-9a-f]{32,}", (), 0, 32),
    Kind("user", "identifier", r"""(?<![A-Za-z0-9_])(?i:(?:user_?name|user|login|client_?id|account_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", (":", "="), 1, 3, base=False),
    Kind("key", "secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}", (), 0, 24, ("[0-9]", "[a-z]", "[A-Z]"), base=False),
    Kind("pass", "secret", r"""(?<![A-Za-z0-9_])(?i:(?:pwd|pass|passphrase|private_?key))["']?\x20*[:=]\x20*["']?([^\s"']{6,})""", (":", "="), 1, 6, base=False),
    Kind("url", "endpoint", r"""(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s"'<>]+""", ("://",), 0, 0, base=False),
    Kind("host", "endpoint", r"(?<![A-Za-z0-9_])[A-Za-z0-9][A-Za-z0-9.-]{0,252}\.[a-z]{2,24}:[0-9]{2,5}(?![A-Za-z0-9_])", (":",), 0, 0, base=False),
)
BASE = tuple(k.name for k in KINDS if k.base)
_ROLES = {"identifier": 0, "secret": 1, "endpoint": 2}


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """All matches of a kind: ``kind, at, gap, size, ok``; the gap is what lies between it and the match before."""
    pattern = F.lit(kind.pattern)
    # side by side, as an array that a lambda reads from outside is made again for each element
    parts = F.zip_with(F.split(text, kind.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))
    if kind.group:
        parts = F.zip_with(parts, F.regexp_extract_all(text, pattern, F.lit(kind.group)), lambda part, group: F.struct(part.gap.alias("gap"), part.match.alias("match"), F.length(group).alias("measured")))
    found = F.filter(parts, lambda part: part.match.isNotNull())

    def entry(part: Column, at: Column) -> Column:
        ok = (part.measured if kind.group else F.length(part.match)) >= kind.least
        for needed in kind.has:
            ok = ok & part.match.rlike(needed)
        return F.struct(F.lit(number).alias("kind"), at.alias("at"), part.gap.alias("gap"), F.length(part.match).alias("size"), ok.alias("ok"))

    there = F.lit(True)
    if kind.gate:
        there = F.contains(text, F.lit(kind.gate[0]))
        for mark in kind.gate[1:]:
            there = there | F.contains(text, F.lit(mark))
    nothing = F.array().cast("array<struct<kind:int,at:int,gap:int,size:int,ok:boolean>>")
    return F.when(there & text.rlike(kind.pattern), F.transform(found, entry)).otherwise(nothing)


def _key(id_col: str, text: Column) -> Column:
    """A name for a row that equal rows share."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.xxhash64(text).cast("string"), F.length(text).cast("string"))


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each span once for equal rows: ``key, kind`` (its number), ``start, end``; failing matches are left out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(_key(id_col, text).alias("key"), F.concat(*[_matches(text, i, k) for i, k in enumerate(KINDS)]).alias("found")).where(F.size("found") > 0)
    # equal rows have equal matches and count once, else they would interleave in the running sums
    each = rows.groupBy("key").agg(F.first("found").alias("found")).select("key", F.explode("found").alias("f")).select("key", "f.*")
    line = Window.partitionBy("key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(line)
    return each.withColumn("end", end).where("ok").select("key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def link_parts(parts: DataFrame) -> DataFrame:
    """The weak candidates that complementary parts support and no base span overlaps."""
    role = F.element_at(F.array(*[F.lit(_ROLES[k.role]) for k in KINDS]), F.col("kind") + 1)
    strong = F.element_at(F.array(*[F.lit(k.base) for k in KINDS]), F.col("kind") + 1)
    parts = parts.withColumn("role", role).withColumn("strong", strong)
    stretch = lambda a, b: F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE)))
    weak = parts.where(~F.col("strong")).withColumn("stretch", stretch(F.col("start") - SCOPE, F.col("end") + SCOPE))
    other = parts.select("key", F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("role").alias("_role"), F.col("strong").alias("_strong")).withColumn("stretch", stretch(F.col("_a"), F.col("_b")))
    met = weak.join(other, ["key", "stretch"]).where((F.col("_a") <= F.col("end") + SCOPE) & (F.col("start") <= F.col("_b") + SCOPE))
    seen = lambda condition: F.max(F.when(condition, 1).otherwise(0))
    apart = (F.col("_role") != F.col("role")) & ((F.col("_b") <= F.col("start")) | (F.col("end") <= F.col("_a")))
    judged = met.groupBy("key", "kind", "start", "end").agg(
        seen(F.col("_strong") & (F.col("_a") < F.col("end")) & (F.col("start") < F.col("_b"))).alias("_within"),
        seen(apart & F.col("_strong")).alias("_base"),
        sum((seen(apart & (F.col("_role") == r)) for r in _ROLES.values()), F.lit(0)).alias("_roles"),
    )
    return judged.where("_within = 0 AND (_base = 1 OR _roles >= 2)").select("key", "kind", "start", "end")


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Counts and digest are those of the base spans; ``spans`` also has the linked
    candidates.  Places are code points, ends exclusive.  Null and empty texts
    have no spans.  Very long texts are read whole, in time linear in their
    length.  Rows that repeat an id are rows of their own, also with different
    texts; an empty table gives none.  Other columns are not read.
    """
    parts = find_parts(docs, id_col, text_col)
    strong = F.col("kind") < len(BASE)
    every = parts.where(strong).unionByName(link_parts(parts))
    span = F.struct("start", "kind", "end")
    spans = every.groupBy("key").agg(F.collect_list(span).alias("_all"), F.collect_list(F.when(strong, span)).alias("_base"), *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(BASE)])
    listed = spans.select("key", *[f"n_{k}" for k in BASE], F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(F.col("_all")).alias("spans"))
    rows = docs.select(F.col(id_col).alias("doc_id"), _key(id_col, F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    zero = F.lit(0).cast("long")
    return rows.join(listed, "key", "left").select("doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in BASE], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
