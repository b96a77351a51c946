"""Token counts as delta-maintained rollups.

A rollup holds additive totals, documents and tokens, by source, language and
tokenizer version.  It never sees texts: it takes batches of changes, each an
insert, a delete or a revised count, turns them into signed contributions, sums
them and appends the sums as the delta of the batch.  Totals are the sums of all
committed deltas.

A batch commits when its marker appears, in one atomic step that fails where the
marker exists.  So a batch that is applied again, after a crash or by two
writers at once, counts once; what an attempt wrote without a marker is never
read.  Compaction replaces deltas by one snapshot that names the batches it
covers.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsync.llm.store import remove

KEYS = ("source", "lang", "tokenizer")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20
#: Fixed value: how byte-level BPE of this vocabulary splits a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A run of white space (as the pattern has it) that is split off before the pattern sees it, as its look-ahead recurses.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{500,}")

_encodings: dict = {}


def _encoding(name: str, vocabulary: bytes):
    """The tokenizer, once for each worker."""
    if name not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        _encodings[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def text_tokens(encoding, text: str) -> int:
    """Number of tokens of a text.

    Of white space before another character the pattern makes a piece without
    the last character, which goes to what follows; at the end it takes all.
    Long runs are cut that way here, so counts are those of the whole text.
    """
    total, at = 0, 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """``source, lang, tokenizer, n_bytes, n_tokens`` of each document; the version is the vocabulary's file name.

    Null and empty texts have no tokens; null sources and languages stay null.
    Very long texts are read whole, one at a time.  Ids play no part, so rows
    that repeat are counted each; an empty table gives no rows, and other
    columns are not read.  The vocabulary is read by the driver, so executors
    need no copy of the file.
    """
    name, data = Path(vocabulary).stem, Path(vocabulary).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY_BYTES} bytes")
    held = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(name, held.value)
        for batch in batches:
            counts = np.fromiter((text_tokens(encoding, t) if (t := x.as_py()) else 0 for x in batch.column(2)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([name] * batch.num_rows, pa.string()), batch.column(3).cast(pa.int64()), pa.array(counts)], names=["source", "lang", "tokenizer", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "source string, lang string, tokenizer string, n_bytes long, n_tokens long")


def signed(changes: DataFrame) -> DataFrame:
    """What each change adds to the totals: ``source, lang, tokenizer, docs, tokens``.

    ``changes`` has ``op`` (``insert``, ``delete`` or ``revise``), the keys, and
    ``tokens_before`` and ``tokens_after`` (null counts as 0).  An insert adds a
    document and its tokens, a delete takes both away, a revision adds the
    difference.  Any other ``op`` is an error.  A document that moves to another
    key is a delete and an insert.
    """
    before, after = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tokens_before", "tokens_after"))
    op = F.col("op")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null"))))).cast("long")
    tokens = F.when(op == "insert", after).when(op == "delete", -before).otherwise(after - before)
    return changes.select(*KEYS, docs.alias("docs"), tokens.alias("tokens"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class TokenRollup:
    """A rollup in a folder of any file system that Spark knows."""

    _SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commit(self, name: str, content: str) -> bool:
        """Make a marker with its content in one step; False where it exists.

        The content is written to a draft and renamed.  ``FileContext`` renames
        without overwriting: the step fails where the marker exists, and is
        atomic on HDFS and on local files.  A store whose rename copies needs a
        committer of its own in the place of this method.
        """
        draft, marker = self._paths(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._paths(f"{self.path}/commits/{name}")
        self._fs.mkdirs(marker.getParent())
        out = self._fs.create(draft, True)
        out.write(content.encode())
        out.close()
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(self._fs.makeQualified(draft).toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(draft), self._fs.makeQualified(marker), options)
        except Py4JJavaError:
            if not self._fs.exists(marker):
                raise
        self._fs.delete(draft, False)
        return self._read(marker) == content

    def _read(self, marker) -> str:
        stream = self._fs.open(marker)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commits(self) -> dict[str, dict]:
        folder = self._paths(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return {}
        return {s.getPath().getName(): json.loads(self._read(s.getPath())) for s in self._fs.listStatus(folder) if not s.getPath().getName().startswith(".")}

    def batches(self) -> set[str]:
        """The batches that count."""
        return {b for c in self._commits().values() for b in c["covers"]}

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes under its name; False if it had been committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches():
            return False
        table = f"{self.path}/deltas/{batch}-{uuid.uuid4().hex}"
        _summed(signed(changes)).write.parquet(table)
        done = self._commit(batch, json.dumps({"table": table, "covers": [batch]}))
        if not done:
            remove(self.spark, table)
        return done

    def _live(self) -> tuple[list[str], set[str]]:
        """The tables to sum, and the batches that they hold, from one listing of the markers."""
        commits = self._commits()
        largest = max((n for n in commits if n.startswith("snapshot.")), key=lambda n: (len(commits[n]["covers"]), n), default=None)
        covered = set(commits[largest]["covers"]) if largest else set()
        used = [n for n in commits if n == largest or (not n.startswith("snapshot.") and n not in covered)]
        return [commits[n]["table"] for n in used], {b for n in used for b in commits[n]["covers"]}

    def _sums(self, tables: list[str]) -> DataFrame:
        rows = self.spark.read.schema(self._SCHEMA).parquet(*tables) if tables else self.spark.createDataFrame([], self._SCHEMA)
        return _summed(rows).where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens``: the sums of all that is committed; keys back at zero are left out.

        An empty rollup has no rows.  Null keys are keys like others.
        """
        return self._sums(self._live()[0])

    def compact(self) -> None:
        """Sum all that is committed into one snapshot; deltas that it covers are no longer read.

        Tables and batches come from one listing, so a batch that commits
        meanwhile is in neither and goes on to count by its own delta.
        """
        tables, covers = self._live()
        table = f"{self.path}/deltas/snapshot-{uuid.uuid4().hex}"
        self._sums(tables).write.parquet(table)
        self._commit(f"snapshot.{len(covers):09d}.{uuid.uuid4().hex}", json.dumps({"table": table, "covers": sorted(covers)}))

    def vacuum(self) -> int:
        """Delete the tables and drafts that no total reads any more, and return how many tables went.

        To be called while no reader of an older total and no writer is at work.
        """
        live = {t.rsplit("/", 1)[1] for t in self._live()[0]}
        folder, gone = self._paths(f"{self.path}/deltas"), 0
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName() not in live:
                gone += bool(self._fs.delete(s.getPath(), True))
        remove(self.spark, f"{self.path}/drafts")
        return gone


def document_changes(counted: DataFrame) -> dict[str, DataFrame]:
    """The batches by which all documents enter a rollup, in order.

    Documents arrive with an estimate of a token for every four bytes; the exact
    count revises it.  Those without tokens stay as documents of 0 tokens, so
    ``docs`` sums to the number of rows.
    """
    estimate = F.ceil(F.col("n_bytes") / 4).cast("long")
    return {
        "arrival": _change(counted, "insert", F.lit(None).cast("long"), estimate),
        "recount": _change(counted.where(estimate != F.col("n_tokens")), "revise", estimate, F.col("n_tokens")),
    }


def corpus_changes(counted: DataFrame) -> dict[str, DataFrame]:
    """``document_changes``, and a batch that deletes the documents that turn out to have no tokens."""
    return document_changes(counted) | {"empty": _change(counted.where("n_tokens = 0"), "delete", F.col("n_tokens"), F.lit(None).cast("long"))}


def _change(rows: DataFrame, op: str, before: Column, after: Column) -> DataFrame:
    return rows.select(F.lit(op).alias("op"), *KEYS, before.alias("tokens_before"), after.alias("tokens_after"))
