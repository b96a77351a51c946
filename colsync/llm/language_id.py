"""Language identification by compression.

Each language has a zstandard dictionary of raw content: pieces of its texts.
A text is compressed with every dictionary, and the one that makes it smallest
names its language.  When the two smallest are nearly as large, a slower
compressor decides between them all; what is still narrow then is rejected.

Texts are lower-cased, and all that is no letter becomes one space.  They are
compressed in parts of ``PART_BYTES``, each with the dictionary at hand, so a
long text is judged by all of its parts and not by its likeness to itself.
Dictionaries have a bounded size, and texts of the table are read once for the
sample and once for the sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsync.llm.words import slices

#: Languages that are learned at most, those with most documents; pieces of a language and characters of a piece.
MAX_LANGUAGES, MAX_PIECES, PIECE_CHARS = 128, 512, 256
#: Documents of a language that are looked at for each piece that is wanted.
SPARE = 4
#: Bytes that are compressed at a time.
PART_BYTES = 2048
#: The smallest size has to be this share below the next one.
MARGIN = 0.01
UNKNOWN = "und"

_LOGS = {"window_log": 18, "hash_log": 16, "chain_log": 16, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
#: Greedy parsing first, optimal parsing where that is too close to call.
QUICK = {"strategy": zstandard.STRATEGY_GREEDY, "search_log": 3, "min_match": 4, **_LOGS}
SLOW = {"strategy": zstandard.STRATEGY_BTLAZY2, "search_log": 5, "min_match": 4, **_LOGS}


def normalised(texts: pa.Array) -> pa.Array:
    """Lower-cased texts, with one space for each run of what is neither letter nor mark; null is empty."""
    letters = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"[^\p{L}\p{M}]+", " ")
    return pc.utf8_trim(letters, " ")


def has_letter(texts: pa.Array) -> pa.Array:
    return pc.match_substring_regex(texts.cast(pa.large_string()).fill_null(""), r"\p{L}")


def parts(text: bytes, most: int = PART_BYTES) -> list[bytes]:
    """The text in pieces of nearly one length, ``most`` bytes at most."""
    n = -(-len(text) // most)
    step = -(-len(text) // max(n, 1))
    return [text[i : i + step] for i in range(0, len(text), step)] if text else []


class Dictionaries:
    """Compressors of the learned languages, in the order of their names."""

    def __init__(self, content: dict[str, bytes]):
        self.names = sorted(content)
        self.quick, self.slow = ([self._compressor(content[n], kind) for n in self.names] for kind in (QUICK, SLOW))

    @staticmethod
    def _compressor(content: bytes, kind: dict) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters(**kind)
        if len(content) < 8:  # too little for a dictionary
            return zstandard.ZstdCompressor(compression_params=params)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=held)

    def guess(self, text: bytes) -> tuple[int, float]:
        """The language that makes a normalised text smallest, the first of equals, and how far the next one is off."""
        cut = parts(text)
        sizes = [sum(len(c.compress(p)) for p in cut) for c in self.quick]
        if margin(sizes) < MARGIN:
            sizes = [sum(len(c.compress(p)) for p in cut) for c in self.slow]
        return sizes.index(min(sizes)), margin(sizes)


def margin(sizes: list[int]) -> float:
    """Share by which the smallest size is below the next one: 0 for equals, 1 if there is no other."""
    if len(sizes) < 2:
        return 1.0
    first, second = sorted(sizes)[:2]
    return 1 - first / second if second else 0.0


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language, from documents outside the held-out fifth.

    ``MAX_PIECES`` documents at most give a piece of ``PIECE_CHARS`` characters
    from anywhere in their text: those with the lowest hash of their id.  A
    repeated id gives one piece, whatever its rows are.  Only these pieces reach
    the driver.  A language whose sampled texts have no letters isn't learned.
    """
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    key = F.xxhash64("id", F.lit(5))
    counts = known.groupBy("lang").agg(F.approx_count_distinct(key).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return {}
    # one row for each learned language
    rates = docs.sparkSession.createDataFrame([(r.lang, min(1.0, SPARE * MAX_PIECES / max(r.n, 1))) for r in counts], "lang string, rate double")
    drawn = known.select("*", key.alias("key")).join(F.broadcast(rates), "lang").where(F.pmod("key", F.lit(1 << 30)) <= F.col("rate") * (1 << 30))
    spare = F.greatest(F.char_length("text") - PIECE_CHARS + 1, F.lit(1))
    piece = F.substring("text", (F.pmod(F.xxhash64("key", F.lit(7)), spare) + 1).cast("int"), F.lit(PIECE_CHARS))
    pieces = drawn.where(F.col("text").rlike(r"\p{L}")).groupBy("lang", "key").agg(F.max(piece).alias("piece")).collect()
    out: dict[str, list] = {}
    for r in sorted(pieces, key=lambda r: (r.key % (1 << 30), r.key)):
        out.setdefault(r.lang, []).append(r.piece)
    content = {lang: " ".join(normalised(pa.array(found[:MAX_PIECES])).to_pylist()).strip().encode() for lang, found in out.items()}
    return {lang: c for lang, c in content.items() if c}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, rejected``.

    ``score`` is the share by which the best language makes the text smaller than the
    next one does; below ``MARGIN`` the guess is ``rejected``, and ``lang_pred``
    is still the best one, by name among equals.  A text without letters, null
    or empty ones too, is ``und`` with score 0, and so are all if nothing could be learned;
    with one language only, every text is that one, with score 1.  Very long
    texts are compressed whole, part by part.  Rows that repeat an id are judged each by its
    own text; a null id is not held out.  An empty table gives none; other columns
    are not read.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Dictionaries(held.value)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
            for lo, hi in slices(ends):
                part = texts.slice(lo, hi - lo)
                said = has_letter(part).to_pylist()
                found = [tables.guess(t.as_buffer().to_pybytes()) if ok and tables.names else (-1, 0.0) for t, ok in zip(normalised(part), said, strict=True)]
                names = [tables.names[i] if i >= 0 else UNKNOWN for i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(names, pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([s < MARGIN for _, s in found], pa.bool_())],
                    names=["doc_id", "lang_pred", "score", "rejected"],
                )

    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = read.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
