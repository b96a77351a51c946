"""Quality classifier: a factorisation machine over hashed words and text statistics.

``score = sigmoid(w0 + sum w_j x_j + sum_{i<j} <v_i, v_j> x_i x_j)``.  The pair
term is computed in linear time as half of ``(sum v x)^2 - sum (v x)^2``.

Features come from the text alone: the share of each hashed word, and statistics
of its structure and of its length (metadata that the text itself gives).  The
machine is fitted in numpy on a bounded sample of labelled texts,
``MAX_TRAINING_DOCS``, and scoring runs over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsync.functions.batches import small_batches
from colsync.llm.words import NOT_SPACE, word_slices

#: Labelled texts that a fit uses at most, the lowest by a hash of the id.
MAX_TRAINING_DOCS = 6000
#: Buckets of hashed words.
BUCKETS = 1 << 12
RANK = 8
EPOCHS = 12

STATISTICS = (
    "log_words", "log_bytes", "word_length", "long_words", "distinct_words", "upper", "digit", "symbol", "stop_mark",
    "comma", "pipe", "white", "line_length", "repeated_lines", "capital_words", "symbol_ends", "top_word", "beyond_ascii",
)

_CLASS = np.zeros((256, 8), np.float32)
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 2] = 1
_CLASS[[33, 46, 63], 3] = 1
_CLASS[44, 4] = 1
_CLASS[124, 5] = 1
_CLASS[[32, *range(9, 14)], 6] = 1
_CLASS[128:, 7] = 1
_SYMBOL = _CLASS[:, 2].astype(bool)
_UPPER = _CLASS[:, 0].astype(bool)


@dataclass
class Features:
    """Sparse rows: ``row, column, value`` of the hashed words, and dense statistics."""

    rows: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    dense: np.ndarray


def features(texts: pa.Array) -> Iterator[Features]:
    """Features of the texts, slice by slice; an empty text has zero in every column."""
    for part in word_slices(texts, NOT_SPACE, lower=False):
        yield _features(part)


def _features(part) -> Features:
    n = part.rows
    count = np.diff(part.bounds).astype(np.float64)
    size = np.diff(part.offsets).astype(np.float64)
    row = part.row
    words, total = np.maximum(count, 1), np.maximum(size, 1)

    histogram = np.zeros((n, 256), np.float64)
    for r in range(n):
        histogram[r] = np.bincount(part.data[part.offsets[r] : part.offsets[r + 1]], minlength=256)
    shares = histogram @ _CLASS / total[:, None]

    per_row = lambda values: np.bincount(row, values, n) / words if len(row) else np.zeros(n)
    length = (part.ends - part.starts).astype(np.float64)
    key = (part.hashes % np.uint64(BUCKETS)).astype(np.int64)
    pair = row * BUCKETS + key
    distinct, times = np.unique(pair, return_counts=True)
    at, column = distinct // BUCKETS, distinct % BUCKETS
    value = times / words[at]
    top = np.zeros(n)
    np.maximum.at(top, at, value)

    line_length, repeated = np.zeros(n), np.zeros(n)
    breaks = np.flatnonzero(part.data == 10)
    low, high = np.searchsorted(breaks, part.offsets[:-1]), np.searchsorted(breaks, part.offsets[1:])
    for r in np.flatnonzero(size):
        lines = part.data[part.offsets[r] : part.offsets[r + 1]].tobytes().split(b"\n") if high[r] > low[r] else [b""]
        line_length[r] = size[r] / len(lines)
        repeated[r] = 1 - len(set(lines)) / len(lines)

    first, last = part.data[part.starts], part.data[part.ends - 1]
    dense = np.stack(
        [
            np.log1p(count) / 10, np.log1p(size) / 12, per_row(length) / 10, per_row(length > 20), np.bincount(at, minlength=n) / words,
            shares[:, 0], shares[:, 1], shares[:, 2], shares[:, 3] * 10, shares[:, 4] * 10, shares[:, 5] * 10, shares[:, 6],
            np.log1p(line_length) / 10, repeated, per_row(_UPPER[first]), per_row(_SYMBOL[last]), top, shares[:, 7],
        ],
        axis=1,
    )
    return Features(n, at, column, value, dense * (size > 0)[:, None])


@dataclass
class FactorisationMachine:
    """Weights of ``BUCKETS`` hashed words followed by the statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def margins(self, f: Features) -> np.ndarray:
        """The score before the sigmoid of each row."""
        dense = np.clip((f.dense - self.mean) / self.scale, -5, 5)
        value = f.value * _WORD_SCALE
        out = self.bias + dense @ self.linear[BUCKETS:] + np.bincount(f.row, value * self.linear[f.column], f.rows)
        scaled = self.factors[f.column] * value[:, None]
        first = _sum_rows(scaled, f.row, f.rows) + dense @ self.factors[BUCKETS:]
        second = _sum_rows(scaled**2, f.row, f.rows) + dense**2 @ self.factors[BUCKETS:] ** 2
        return out + 0.5 * (first**2 - second).sum(axis=1)

    def scores(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(f), -30, 30)))


#: Word shares are small; this brings them to the size of the statistics.
_WORD_SCALE = 4.0


def _sum_rows(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of consecutive rows of ``values`` by the sorted ``row``."""
    out = np.zeros((rows, values.shape[1]))
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


def fit(sets: list[Features], labels: np.ndarray, seed: int = 11) -> FactorisationMachine:
    """Fit by Adam on the logistic loss; classes count alike.  One class alone gives a constant score."""
    rng = np.random.default_rng(seed)
    dense = np.concatenate([f.dense for f in sets]) if sets else np.zeros((0, len(STATISTICS)))
    width = BUCKETS + len(STATISTICS)
    machine = FactorisationMachine(0.0, np.zeros(width), rng.normal(0, 0.02, (width, RANK)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    good = labels == 1
    if not len(labels) or good.all() or not good.any():
        machine.factors[:] = 0
        machine.bias = 0.0 if not len(labels) else 3.0 if good.any() else -3.0
        return machine
    machine.mean, machine.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-3
    base = np.cumsum([0, *(f.rows for f in sets)])
    row = np.concatenate([f.row + b for f, b in zip(sets, base, strict=False)])
    column, value = np.concatenate([f.column for f in sets]), np.concatenate([f.value for f in sets])
    bounds = np.searchsorted(row, np.arange(len(labels) + 1))
    weight = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    params = [np.zeros(1), machine.linear, machine.factors]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        rate = 0.02 * 0.8**epoch
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            take = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in batch])
            counts = (bounds[batch + 1] - bounds[batch]).astype(np.int64)
            f = Features(len(batch), np.repeat(np.arange(len(batch)), counts), column[take], value[take], dense[batch])
            grads = _gradients(machine, f, good[batch].astype(float), weight[batch])
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            machine.bias = float(params[0][0])
    return machine


def _gradients(machine: FactorisationMachine, f: Features, good: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    x = np.clip((f.dense - machine.mean) / machine.scale, -5, 5)
    value = f.value * _WORD_SCALE
    scaled = machine.factors[f.column] * value[:, None]
    first = _sum_rows(scaled, f.row, f.rows) + x @ machine.factors[BUCKETS:]
    error = (machine.scores(f) - good) * weight / len(good)
    linear = 1e-5 * machine.linear
    linear[:BUCKETS] += np.bincount(f.column, value * error[f.row], BUCKETS)
    linear[BUCKETS:] += x.T @ error
    factors = 1e-4 * machine.factors
    change = (error[f.row] * value)[:, None] * (first[f.row] - scaled)
    for k in range(RANK):
        factors[:BUCKETS, k] += np.bincount(f.column, change[:, k], BUCKETS)
    factors[BUCKETS:] += x.T @ (error[:, None] * first) - (x**2).T @ error[:, None] * machine.factors[BUCKETS:]
    return [np.array([error.sum()]), linear, factors]


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_TRAINING_DOCS) -> FactorisationMachine:
    """Fit on at most ``max_docs`` labelled documents outside the held-out third.

    Rows without a label or with one other than 0 and 1 teach nothing; of
    several labels of a document the smallest counts, of several texts the
    largest.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    # max_docs ids are a documented bound, far below any broadcast limit
    sample = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(max_docs))
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(sample, "_id")
    found = found.groupBy("_id", "_label").agg(F.max("_text").alias("_text"))  # a repeated id counts once
    encoded = found.mapInArrow(_encoded, "id long, label long, column binary, value binary, dense binary")
    rows = sorted(encoded.collect(), key=lambda r: r.id)
    sets, label = [], np.array([r.label for r in rows], np.int64)
    if rows:
        columns, values = [np.frombuffer(r.column, np.int32) for r in rows], [np.frombuffer(r.value, np.float64) for r in rows]
        counts = [len(c) for c in columns]
        dense = np.stack([np.frombuffer(r.dense, np.float64) for r in rows])
        sets = [Features(len(rows), np.repeat(np.arange(len(rows)), counts), np.concatenate(columns).astype(np.int64), np.concatenate(values), dense)]
    return fit(sets, label)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of (id, label, text) rows, packed: at most ``BUCKETS`` entries a text."""
    for batch in batches:
        done = 0
        for f in features(batch.column(2)):
            bounds = np.searchsorted(f.row, np.arange(f.rows + 1))
            cut = lambda values: pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(done, f.rows).cast(pa.int64()), batch.column(1).slice(done, f.rows).cast(pa.int64()), cut(f.column.astype(np.int32)), cut(f.value), pa.array([d.tobytes() for d in f.dense], pa.binary())],
                names=["id", "label", "column", "value", "dense"],
            )
            done += f.rows


def score(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, score`` between 0 and 1; null and empty texts get the score of no features."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.scores(f) for f in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Labels of the held-out third are never read.  Without usable labels every
    score is 0.5; an empty table gives no rows.  Null and empty texts get the
    score of no features, very long ones are read whole, a text at a time.
    Rows that repeat an id are scored each by its own text; ids are whole
    numbers, and a null one is not held out.  Other columns are not read.
    """
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents with a score of ``threshold`` or more, all their columns, filtered where they are read.

    Without usable labels all are kept.  Ids may be null or repeat: each row is
    judged by its own text, null and empty ones as texts without features.  Very
    long texts are read whole; other columns are carried along, whatever their
    names.  An empty table gives none.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.scores(f) >= threshold for f in features(batch.column(place).cast(pa.string()))]
            if found:
                yield batch.filter(pa.array(np.concatenate(found)))

    return docs.mapInArrow(run, docs.schema)
