"""Benchmark decontamination by winnowing.

Both sides are cut into words; every ``K`` words in a row get a hash.  Winnowing
keeps the minimum hash of each ``WINDOW - K + 1`` neighbouring hashes, so two
texts that share ``WINDOW`` words in a row keep a common fingerprint inside the
shared span.  The fingerprints of the documents are joined with those of the
benchmark, and every hit is extended: the windows of ``WINDOW`` words around it
are compared with the benchmark's own windows.  Items of fewer words than that
are one window each and are looked up at their full length.

The benchmark side goes to the executors in blocks of at most ``MAX_ITEM_WORDS``
words, a proven bound; a larger benchmark takes further passes over the
documents, whose results are carried along in the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsync.llm.words import ALNUM, Words, mix, word_slices

WINDOW = 10
K = 5
#: Words of benchmark text that are broadcast at once: about 100 MB of index.
MAX_ITEM_WORDS = 2_000_000
#: Hits that are extended at a time.
_HITS = 1 << 18

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0xD1342543DE82EF95)


def grams(words: Words, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each ``n`` words in a row, and whether they are in one text."""
    h = words.hashes
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= _STEP
        out += h[i : len(h) - n + 1 + i]
    return mix(out + np.uint64(n)), row[: len(out)] == row[n - 1 :]


def winnow(hashes: np.ndarray, inside: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions of the hashes that are the minimum of a window of ``WINDOW - K + 1`` within one text; ties all count."""
    wide = WINDOW - K + 1
    n = len(hashes) - wide + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = hashes[:n].copy()
    for i in range(1, wide):
        np.minimum(least, hashes[i : n + i], out=least)
    whole = inside[:n] & (row[:n] == row[WINDOW - 1 : WINDOW - 1 + n])
    kept = np.zeros(len(hashes), bool)
    for i in range(wide):
        kept[i : n + i] |= whole & (hashes[i : n + i] == least)
    return np.flatnonzero(kept)


class ItemIndex:
    """Fingerprints and windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [name for name, _ in items]
        prints, lengths, windows, owners = [], [], [], []
        for part in word_slices(pa.array([text for _, text in items], pa.string()), ALNUM):
            row, count = part.row, np.diff(part.bounds)
            five, inside = grams(part, row, K)
            prints.append(five[winnow(five, inside, row)])
            for n in {WINDOW, *(int(x) for x in np.unique(count) if 0 < x < WINDOW)}:
                full, whole = grams(part, row, n)
                at = np.flatnonzero(whole & (count[row[: len(full)]] == n if n < WINDOW else True))
                lengths.append(np.full(len(at), n, np.int8))
                windows.append(full[at])
                owners.append(part.row0 + row[at])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.prints >> np.uint64(48)).astype(np.int64)] = True
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if windows:
            length, window, owner = np.concatenate(lengths), np.concatenate(windows), np.concatenate(owners)
            for n in np.unique(length):
                pairs = np.unique(np.stack([window[length == n], owner[length == n].astype(np.uint64)]), axis=1)
                keys, first = np.unique(pairs[0], return_index=True)
                self.windows[int(n)] = keys, np.append(first, pairs.shape[1]), pairs[1].astype(np.int64)

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """For each wanted hash its place among the sorted keys, or -1."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def hits(self, part: Words, row: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Matched windows: first words, the number of words, places among the windows of that length."""
        five, inside = grams(part, row, K)
        if len(five):
            at = winnow(five, inside, row)
            at = at[self.seen[(five[at] >> np.uint64(48)).astype(np.int64)]]
            at = at[self.find(self.prints, five[at]) >= 0]
            if len(at):
                full, whole = grams(part, row, WINDOW)
                for i in range(0, len(at), _HITS):
                    near = (at[i : i + _HITS, None] - np.arange(WINDOW - K + 1)).ravel()
                    near = np.unique(near[(near >= 0) & (near < len(full))])
                    near = near[whole[near]]
                    place = self.find(self.windows.get(WINDOW, (np.zeros(0, np.uint64),))[0], full[near])
                    yield near[place >= 0], WINDOW, place[place >= 0]
        for n, (keys, _, _) in self.windows.items():
            if n < WINDOW:
                full, whole = grams(part, row, n)
                seen = np.zeros(1 << 16, bool)
                seen[(keys >> np.uint64(48)).astype(np.int64)] = True
                at = np.flatnonzero(whole & seen[(full >> np.uint64(48)).astype(np.int64)])
                place = self.find(keys, full[at])
                yield at[place >= 0], n, place[place >= 0]

    def owners(self, n: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items that hold each of some windows: index into ``place``, and the item."""
        _, first, owner = self.windows[n]
        count = first[place + 1] - first[place]
        which = np.repeat(np.arange(len(place)), count)
        within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return which, owner[first[place][which] + within]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _found(index: ItemIndex, texts: pa.Array) -> tuple[np.ndarray, list, list]:
    """The number of words, hit spans (first, last, ...) and items of each text; None where there are none."""
    n_words = np.zeros(len(texts), np.int64)
    spans: list[list[int] | None] = [None] * len(texts)
    items: list[list[str] | None] = [None] * len(texts)
    for part in word_slices(texts, ALNUM):
        n_words[part.row0 : part.row0 + part.rows] = np.diff(part.bounds)
        row = part.row
        edge = np.zeros(len(row) + 1, np.int64)
        pairs: list[np.ndarray] = []
        for first, n, place in index.hits(part, row):
            np.add.at(edge, first, 1)
            np.add.at(edge, first + n, -1)
            distinct = np.unique(row[first] * (1 << 32) + place)
            which, owner = index.owners(n, distinct & 0xFFFFFFFF)
            pairs.append(np.unique((distinct[which] >> 32) * (1 << 32) + owner))
        if not any(map(len, pairs)):
            continue
        hit = np.cumsum(edge[:-1]) > 0
        for r in np.unique(row[hit]):
            lo, hi = part.bounds[r], part.bounds[r + 1]
            spans[part.row0 + r] = np.flatnonzero(np.diff(np.concatenate(([0], hit[lo:hi].view(np.int8), [0])))).tolist()
        both = np.unique(np.concatenate(pairs))
        for r, group in zip(*_grouped(both >> 32, both & 0xFFFFFFFF), strict=True):
            items[part.row0 + r] = [index.names[i] for i in group if index.names[i] is not None]
    return n_words, spans, items


def _scan(index):
    """``_found`` for each batch of rows, added to what earlier blocks of items have found in the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = _found(index.value, batch.column(1))
            spans = [_union(a, b) for a, b in zip(batch.column(3).to_pylist(), spans, strict=True)]
            items = [sorted({*a, *b}) if a and b else a or b for a, b in zip(batch.column(4).to_pylist(), items, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words), pa.array(spans, _OUT.field(2).type), pa.array(items, _OUT.field(3).type)], names=["doc_id", "text", *_OUT.names[1:]])

    return run


def _clean(index, place: int):
    """The rows whose text, at ``place``, has no hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = _found(index.value, batch.column(place).cast(pa.string()))[1]
            yield batch.filter(pa.array([s is None for s in spans], pa.bool_()))

    return run


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Values of each key; the keys come sorted."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    return [int(keys[i]) for i in [0, *edges]], np.split(values, edges)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, by a hash of their text; what one block holds is all that the driver holds."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0.0))).first()[0]
    blocks = int(size // MAX_ITEM_WORDS) + 1
    for k in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64(F.coalesce("item", F.lit("")), "text"), F.lit(blocks)) == k).collect()]


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, items``.

    ``spans`` holds the first word and the word after the last of every hit
    stretch, one after the other, and ``items`` the benchmark items found;
    both are null where nothing was found.  Null and empty texts have no words.
    An empty benchmark finds nothing.  Items that repeat an id are one item;
    those without an id make hits but are not listed.  Every document row comes
    out on its own, so ids may be null or repeat; they are whole numbers.  Very
    long texts are read whole, a text at a time.  Other columns are not read.
    """
    spark = docs.sparkSession
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("n_words", "long"), ("spans", "array<long>"), ("items", "array<string>"))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *none)
    for items in item_blocks(benchmark, item_col, item_text_col):
        rows = rows.mapInArrow(_scan(spark.sparkContext.broadcast(ItemIndex(items))), "doc_id long, text string, n_words long, spans array<long>, items array<string>")
    return rows.drop("text")


def _union(before: list[int] | None, more: list[int] | None) -> list[int] | None:
    """Stretches of two passes over a document, sorted and joined where they touch; null for none."""
    if not before or not more:
        return before or more
    out: list[int] = []
    for lo, hi in sorted([*zip(before[::2], before[1::2], strict=True), *zip(more[::2], more[1::2], strict=True)]):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def digest(spans: DataFrame) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` from ``contaminated_spans``."""
    spread = F.coalesce(F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    names = F.coalesce(F.array_sort(F.array_distinct("items")), F.array().cast("array<string>"))
    return spans.select("doc_id", "n_words", spread.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (spread > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents with no word in a benchmark window, all their columns, filtered where they are read.

    Each block of items takes out its own, so nothing is shuffled however large the benchmark is.
    Rows without words stay, and ids play no part.  Very long texts are read
    whole; other columns are carried along, whatever their names.  An empty
    table gives no rows, an empty benchmark takes none out.
    """
    context, place, schema = docs.sparkSession.sparkContext, docs.columns.index(text_col), docs.schema
    for items in item_blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_clean(context.broadcast(ItemIndex(items)), place), schema)
    return docs
