"""Phrase collocations by contiguous pattern growth in the manner of PrefixSpan.

A word's projection is the list of its occurrences, each pointing at the words
that follow it in its piece of text.  Phrases grow to the right, depth first, and
only from prefixes that are frequent: a sorted list of pointers has the
occurrences of every longer prefix side by side, as a range.

Projections are dealt to tasks by prefix.  A task reads some MB of text,
collapses equal contexts (a word and the three that follow) to one pointer with
a count, and sends them on in packed blocks, a block for each bucket of
prefixes.  The task of a bucket merges its blocks and grows its prefixes.

No prefix is too frequent for that.  One that holds a fair share of all words is
found beforehand and dealt by one word more, as deep as needed: what is
seldom everywhere can't be frequent in all, so tasks report only prefixes that
are frequent in what they read.  A bucket that turns out larger than a task's
memory is not grown but dealt again, deeper, in another round.  Counts of
prefixes that several buckets share are summed afterwards.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsync.llm.store import Scratch
from colsync.llm.words import LOWER, mix, slices, text_bytes

#: Words of a phrase, occurrences of a candidate, percent of its occurrences that a longer one has to cover, rows for each language.
MAX_WORDS, MIN_COUNT, COVER_PERCENT, TOP = 4, 30, 80, 2000
UNKNOWN = "und"
#: Bytes of text that are projected together.
SLICE_BYTES = 8 << 20
#: A prefix with more than one in so many words is dealt deeper from the start, if it has this many occurrences at least.
HOT_SHARE, HOT_LEAST = 4096, 4096
#: Contexts of a bucket in the mean, the fewest and most buckets, and contexts that a task holds.
BUCKET_CONTEXTS, MIN_BUCKETS, MAX_BUCKETS, MAX_CONTEXTS = 1 << 19, 64, 4096, 1 << 21

#: Bytes between words, and between pieces.
_GAP, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP[[0x20, 0x09]] = True
_GAP |= _STOP
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Contexts:
    """Words with those after them, sorted: four columns of tokens, 0 past the end of a piece, and how often each row occurs.

    Token ``t`` is the word ``words[t - 1]`` in the language ``langs[lang[t - 1]]``.
    """

    words: pa.Array
    langs: list[str]
    lang: np.ndarray
    columns: list[np.ndarray]
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.count)

    def hashes(self) -> np.ndarray:
        """A hash of each token and, at 0, of the end; the same in every task."""
        langs = hash_strings(pa.array(self.langs, pa.string()))
        own = mix(hash_strings(self.words) ^ mix(langs[self.lang] + _STEP)) if len(self.words) else np.zeros(0, np.uint64)
        return np.concatenate([np.zeros(1, np.uint64), own])

    def prefixes(self) -> list[np.ndarray]:
        """The hash of each row's first word, of its first two, three and four."""
        token, out = self.hashes(), []
        for c in self.columns:
            out.append(token[c] if not out else mix(out[-1] * _STEP + token[c]))
        return out


def hash_strings(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    data, at = text_bytes(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    length = np.diff(at)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(at[:-1], length)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1) + place.astype(np.uint64) * np.uint64(257)), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + length.astype(np.uint64) * _STEP)


def collapsed(words: pa.Array, langs: list[str], lang: np.ndarray, columns: list[np.ndarray], count: np.ndarray) -> Contexts:
    """Contexts in order, equal ones as one row."""
    wide = np.int64(len(lang) + 1)
    first, last = columns[0] * wide + columns[1], columns[2] * wide + columns[3]
    order = np.lexsort((last, first))
    first, last = first[order], last[order]
    new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])])) if len(order) else order
    summed = np.add.reduceat(count[order], new) if len(order) else count
    return Contexts(words, langs, lang, [first[new] // wide, first[new] % wide, last[new] // wide, last[new] % wide], summed)


def _encoded(words: pa.Array, lang: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pairs of word and language: their words, their languages, and for each input its token from 1."""
    held = words.dictionary_encode()
    code, size = held.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.int64(max(len(held.dictionary), 1))
    distinct, token = np.unique(lang * size + code, return_inverse=True)
    return held.dictionary.take(pa.array(distinct % size)), (distinct // size).astype(np.int64), token.reshape(-1) + 1


def contexts(data: np.ndarray, offsets: np.ndarray, langs: list[str], lang: np.ndarray) -> tuple[Contexts, np.ndarray]:
    """The contexts of some texts, and the number of words of each text."""
    data = LOWER[data]
    inside = ~_GAP[data]
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    per_text = np.diff(bounds)
    row = np.repeat(np.arange(len(per_text)), per_text)
    stops = np.cumsum(_STOP[data], dtype=np.int32)[starts] if len(starts) else starts
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    words, token_lang, token = _encoded(words, lang[row])
    joined = np.concatenate([(stops[1:] == stops[:-1]) & (row[1:] == row[:-1]), [False]]) if len(starts) else np.zeros(0, bool)
    columns = [token]
    while len(columns) < MAX_WORDS:
        columns.append(np.where(joined, np.concatenate([columns[-1][1:], [0]]) if len(token) else token, 0))
    return collapsed(words, langs, token_lang, columns, np.ones(len(token), np.int64)), per_text


def read_slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[Contexts, list[str], np.ndarray]]:
    """Contexts of (lang, text) rows, some MB of text at a time, with the languages and their numbers of words."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in slices(offsets, size):
            coded = batch.column(0).slice(lo, hi - lo).fill_null(UNKNOWN).dictionary_encode()
            langs, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found, per_text = contexts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], langs, lang)
            yield found, langs, np.bincount(lang, per_text, len(langs)).astype(np.int64)


# -- packed blocks ------------------------------------------------------------------


def pack(c: Contexts, rows: np.ndarray) -> bytes:
    """Some of the contexts with the words that they need, compressed."""
    used, local = np.unique(np.concatenate([x[rows] for x in c.columns]), return_inverse=True)
    skip = int(len(used) > 0 and used[0] == 0)  # the end has token 0 in every block
    local = local.reshape(-1) + (1 - skip)
    named = used[skip:] - 1
    langs, lang = np.unique(c.lang[named], return_inverse=True)
    data, at = text_bytes(c.words.take(pa.array(named)))
    names = [c.langs[i].encode() for i in langs]
    small = np.uint16 if len(named) < 65535 else np.uint32
    head = struct.pack("<IIIB", len(rows), len(named), len(names), small == np.uint32)
    body = [np.array([len(n) for n in names], np.uint32).tobytes(), b"".join(names), lang.astype(np.uint32).tobytes(), np.diff(at).astype(np.uint32).tobytes(), data.tobytes(), local.astype(small).tobytes(), c.count[rows].tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))


def unpack(block: bytes | pa.Buffer) -> Contexts:
    """The contexts of a packed block."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, n_words, n_langs, wide = struct.unpack_from("<IIIB", raw)
    at = struct.calcsize("<IIIB")

    def take(kind, size: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, size, at)
        at += out.nbytes
        return out

    langs = [take(np.uint8, int(k)).tobytes().decode() for k in take(np.uint32, n_langs)]
    lang = take(np.uint32, n_words).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(take(np.uint32, n_words), dtype=np.int64)])
    data = take(np.uint8, int(ends[-1]))
    words = pa.Array.from_buffers(pa.large_string(), n_words, [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
    columns = take(np.uint32 if wide else np.uint16, MAX_WORDS * n).astype(np.int64).reshape(MAX_WORDS, n)
    return Contexts(words, langs, lang, list(columns), take(np.int64, n))


def merged(held: list[Contexts]) -> Contexts:
    """Contexts of several blocks as one."""
    langs = sorted({name for c in held for name in c.langs})
    place = {name: i for i, name in enumerate(langs)}
    lang = np.concatenate([np.array([place[name] for name in c.langs], np.int64)[c.lang] for c in held])
    words, token_lang, token = _encoded(pa.concat_arrays([c.words for c in held]), lang)
    columns, base = [[] for _ in range(MAX_WORDS)], 0
    for c in held:
        here = np.concatenate([[0], token[base : base + len(c.lang)]])
        base += len(c.lang)
        for out, old in zip(columns, c.columns, strict=True):
            out.append(here[old])
    return collapsed(words, langs, token_lang, [np.concatenate(x) for x in columns], np.concatenate([c.count for c in held]))


def dealt(c: Contexts, buckets: int, hot: list[np.ndarray], least: int, turn: int, within: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """``bucket, depth, block``: each context by its shortest prefix of ``least`` words or more that isn't hot.

    A bucket that is dealt again, ``within``, goes to buckets of its own.
    """
    prefixes = c.prefixes()
    depth, open_ = np.full(len(c), MAX_WORDS), np.ones(len(c), bool)
    key = prefixes[-1].copy()
    for words in range(1, MAX_WORDS):
        here = open_ & ~np.isin(prefixes[words - 1], hot[words - 1]) if words >= least else np.zeros(len(c), bool)
        depth[here], key[here] = words, prefixes[words - 1][here]
        open_ &= ~here
    bucket = (mix(key + np.uint64(turn) * _STEP) % np.uint64(buckets)).astype(np.int64)
    place = bucket * (MAX_WORDS + 1) + depth
    order = np.argsort(place, kind="stable")
    ends = np.flatnonzero(np.diff(place[order], append=-1)) + 1
    for lo, hi in zip([0, *ends[:-1]], ends, strict=False):
        rows = order[lo:hi]
        yield (within * buckets + int(bucket[rows[0]])) % (1 << 63), int(depth[rows[0]]), pack(c, rows)


# -- growth -------------------------------------------------------------------------


def grow(c: Contexts, depth: int, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Phrases as tokens with their occurrences, depth first.

    The contexts are all that begin with their first ``depth`` words.  Shorter
    prefixes have more of them elsewhere and are reported whatever their count;
    those of ``depth`` words or more only with ``least`` or more occurrences.
    """
    until = np.concatenate([[0], np.cumsum(c.count)])

    def extend(prefix: tuple[int, ...], lo: int, hi: int) -> Iterator[tuple[tuple[int, ...], int]]:
        column = c.columns[len(prefix)][lo:hi]
        first = np.flatnonzero(np.diff(column, prepend=-1)) + lo
        last = np.append(first[1:], hi)
        total = until[last] - until[first]
        go_on = c.columns[len(prefix)][first] > 0
        if len(prefix) + 1 >= depth:
            go_on &= total >= least
        for i in np.flatnonzero(go_on):
            longer = (*prefix, int(c.columns[len(prefix)][first[i]]))
            yield longer, int(total[i])
            if len(longer) < MAX_WORDS:
                yield from extend(longer, int(first[i]), int(last[i]))

    if len(c):
        yield from extend((), 0, len(c))


_PROJECTED = pa.schema([("bucket", pa.int64()), ("depth", pa.int32()), ("block", pa.binary())])
_GROWN = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64()), *_PROJECTED])
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}


def _schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _frequent_here(share: int, size: int):
    """For ``mapInArrow``: words of each language, ``depth`` 0, and prefixes that are frequent in a slice, ``lang, depth, key, n``."""
    schema = pa.schema([("lang", pa.string()), ("depth", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for c, langs, n_words in read_slices(batches, size):
            rows = [(name, 0, 0, int(n)) for name, n in zip(langs, n_words, strict=True)]
            most = int(n_words.sum()) // share
            for words, keys in enumerate(c.prefixes()[: MAX_WORDS - 1], 1):
                first = np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint64(1))) if len(keys) else []
                if len(first):
                    total = np.add.reduceat(c.count, first)
                    rows += [(None, words, int(k), int(n)) for k, n in zip(keys[first][total > most].view(np.int64), total[total > most], strict=True)]
            yield _rows(rows, schema)

    return run, _schema(schema)


def _project(buckets: int, hot: list[np.ndarray], size: int):
    """For ``mapInArrow``: contexts of (lang, text) rows as packed blocks."""

    def run(batches):
        for c, _, _ in read_slices(batches, size):
            yield _rows(list(dealt(c, buckets, hot, 1, 0)), _PROJECTED)

    return run


def _grow(buckets: int, turn: int, least: int, most: int):
    """For ``mapInArrow`` over blocks sorted by bucket and depth: phrases, and blocks of buckets that are too large, dealt anew."""
    none = [np.zeros(0, np.uint64)] * MAX_WORDS

    def again(c: Contexts, bucket: int, depth: int):
        yield _rows([(None,) * 4 + row for row in dealt(c, buckets, none, min(depth + 1, MAX_WORDS), turn, bucket + 1)], _GROWN)

    def finish(held: list[Contexts], depth: int):
        c = merged(held)
        words, rows = c.words.to_pylist(), []
        for tokens, a in grow(c, depth, least):
            rows.append((c.langs[c.lang[tokens[0] - 1]], " ".join([words[t - 1] for t in tokens]), len(tokens), a, None, None, None))
            if len(rows) == 1 << 16:
                yield _rows(rows, _GROWN)
                rows = []
        yield _rows(rows, _GROWN)

    def run(batches):
        place, held, size, large = None, [], 0, False
        for batch in batches:
            for i, (bucket, depth) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if (bucket, depth) != place:
                    if held:
                        yield from finish(held, place[1])
                    place, held, size, large = (bucket, depth), [], 0, False
                c = unpack(batch.column(2)[i].as_buffer())
                if large:
                    yield from again(c, bucket, depth)
                    continue
                held, size = [*held, c], size + len(c)
                if size > most:
                    held = [merged(held)]
                    size = len(held[0])
                    if size > most // 2:
                        yield from again(held[0], bucket, depth)
                        held, size, large = [], 0, True
        if held:
            yield from finish(held, place[1])

    return run


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Words and phrases of up to four words with ``least`` occurrences or more, ``lang, phrase, words, a``, and words of each language, ``lang, n``.

    Both are written tables.  Phrases lie within one piece of a text; see ``mine``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    run, schema = _frequent_here(HOT_SHARE, SLICE_BYTES)
    seen = scratch.put(rows.mapInArrow(run, schema), "seen")
    n_words = scratch.put(seen.where("depth = 0").groupBy("lang").agg(F.sum("n").cast("long").alias("n")), "words")
    total = n_words.agg(F.sum("n")).first()[0] or 0
    # fewer than HOT_SHARE prefixes of each length have so many occurrences, whatever the input
    often = seen.where("depth > 0").groupBy("depth", "key").agg(F.sum("n").alias("n")).where(F.col("n") > max(total // HOT_SHARE, HOT_LEAST)).collect()
    hot = [np.array(sorted(r.key % (1 << 64) for r in often if r.depth == d), np.uint64) for d in range(1, MAX_WORDS + 1)]
    buckets = min(max(total // BUCKET_CONTEXTS, MIN_BUCKETS), MAX_BUCKETS)
    blocks, grown, turn = rows.mapInArrow(_project(buckets, hot, SLICE_BYTES), _schema(_PROJECTED)), [], 0
    while blocks is not None:
        turn += 1
        dealt_out = blocks.repartition(F.col("bucket")).sortWithinPartitions("bucket", "depth")
        grown.append(scratch.put(dealt_out.mapInArrow(_grow(buckets, turn, least, MAX_CONTEXTS), _schema(_GROWN)), "grown"))
        blocks = grown[-1].where("block IS NOT NULL").select(*_PROJECTED.names)
        blocks = None if blocks.isEmpty() else blocks
    found = grown[0]
    for more in grown[1:]:
        found = found.unionByName(more)
    summed = found.where("phrase IS NOT NULL").groupBy("lang", "phrase", "words").agg(F.sum("a").cast("long").alias("a")).where(F.col("a") >= least)
    summed = scratch.put(summed, "frequent")
    scratch.drop("seen", "grown")
    return summed, n_words


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored(frequent: DataFrame) -> DataFrame:
    """Each phrase of two words or more by its lowest-scoring cut: ``lang, phrase, a, l, r, score``; of equal scores the first cut counts."""
    part = frequent.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = frequent.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    left = cuts.join(part.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = left.join(part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def covered(frequent: DataFrame, percent: int = COVER_PERCENT) -> DataFrame:
    """Phrases that lie inside a longer one with ``percent`` of their occurrences or more: ``lang, phrase``."""
    words = F.split("phrase", " ")
    inner = [F.when(F.col("words") >= at + n - 1, F.array_join(F.slice(words, at, n), " ")) for n in range(2, MAX_WORDS) for at in range(1, MAX_WORDS - n + 2)]
    inside = frequent.where("words > 2").select("lang", F.col("a").alias("longer"), "phrase", F.explode(F.array(*inner)).alias("part")).where("part IS NOT NULL AND part <> phrase")
    most = inside.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("longer").alias("longer"))
    joined = most.join(frequent.select("lang", "phrase", "a"), ["lang", "phrase"])
    return joined.where(_exact(F.col("longer")) * 100 >= _exact(F.col("a")) * percent).select("lang", "phrase")


#: Parts of a language that are ranked apart first, so that no task sorts all phrases of one.
_RANK_PARTS = 32


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """The strongest phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased in A-Z and cut at ``.,;:!?`` and line ends into pieces,
    those at spaces and tabs into words.  A null language is ``und``; null and empty
    texts have no words, and a language without candidates no rows.  Repeated
    rows count each time.  Very long texts are projected whole, one at a time.  An
    empty table gives none; other columns are not read.
    """
    frequent, n_words = frequent_phrases(docs, text_col, lang_col)
    kept = scored(frequent).join(covered(frequent), ["lang", "phrase"], "left_anti")
    by = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_RANK_PARTS))
    ahead = kept.withColumn("_at", F.row_number().over(Window.partitionBy("lang", part).orderBy(*by))).where(F.col("_at") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
