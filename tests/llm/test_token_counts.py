"""Rollups against plain sums, and commits that are tried again."""

import base64
import random
from collections import Counter

import pytest
import tiktoken

from colsync.llm import token_counts as tc
from colsync.llm.queries import op1_token_counts

SF = "/root/testdata/sf0.01"


def plain(rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tc.VOCABULARY, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=tc.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, tokens = Counter(), Counter()
    for source, lang, text in rows:
        n = len(encoding.encode_ordinary(text or ""))
        if n:
            docs[source, lang] += 1
            tokens[source, lang] += n
    return {(s, g, "byte_bpe_50k", docs[s, g], tokens[s, g]) for s, g in docs}


def test_whole_table(spark):
    rows = [(r.source, r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op1_token_counts(spark, SF)
    assert {tuple(r) for r in got.select(*tc.KEYS, "docs", "tokens").collect()} == plain(rows)


def test_edges(spark, tmp_path):
    rows = [("a", "en", None), ("a", "en", ""), (None, "en", "one two"), ("", None, "é ö <|endoftext|>"), ("b", "en", "x" * 200_000), ("b", "en", "x" * 200_000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "source string, lang string, text string, tokenizer string, docs string")
    rollup = tc.TokenRollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    for name, changes in tc.corpus_changes(tc.count_tokens(df)).items():
        assert rollup.apply(name, changes)
    assert {tuple(r) for r in rollup.totals().collect()} == plain(rows)
    assert tc.count_tokens(df.limit(0)).count() == 0


def test_random_batches_retries_and_compaction(spark, tmp_path):
    rng = random.Random(6)
    schema = "op string, source string, lang string, tokenizer string, tokens_before long, tokens_after long"
    rollup, docs, tokens, live = tc.TokenRollup(spark, f"file://{tmp_path}/r"), Counter(), Counter(), []
    for b in range(8):
        changes = []
        for _ in range(40):
            op = rng.choice(["insert", "insert", "delete", "revise"]) if live else "insert"
            if op == "insert":
                doc = [(rng.choice(["a", "b", None]), rng.choice(["en", "fr"]), rng.choice(["v1", "v2"])), rng.randint(0, 50)]
                live.append(doc)
                changes.append((op, *doc[0], None, doc[1]))
                docs[doc[0]] += 1
                tokens[doc[0]] += doc[1]
            elif op == "delete":
                doc = live.pop(rng.randrange(len(live)))
                changes.append((op, *doc[0], doc[1], None))
                docs[doc[0]] -= 1
                tokens[doc[0]] -= doc[1]
            else:
                doc, now = rng.choice(live), rng.randint(0, 50)
                changes.append((op, *doc[0], doc[1], now))
                tokens[doc[0]] += now - doc[1]
                doc[1] = now
        df = spark.createDataFrame(changes, schema)
        assert rollup.apply(f"b{b}", df)
        assert not rollup.apply(f"b{b}", df)
        if b in (3, 5):
            rollup.compact()
            assert not rollup.apply("b1", df)
        want = {(*k, docs[k], tokens[k]) for k in docs if docs[k] or tokens[k]}
        assert {tuple(r) for r in tc.TokenRollup(spark, f"file://{tmp_path}/r").totals().collect()} == want
    assert rollup.batches() == {f"b{b}" for b in range(8)}


def test_failed_attempt_leaves_no_trace(spark, tmp_path):
    rollup = tc.TokenRollup(spark, f"file://{tmp_path}/r")
    schema = "op string, source string, lang string, tokenizer string, tokens_before long, tokens_after long"
    with pytest.raises(Exception, match="unknown op"):
        rollup.apply("x", spark.createDataFrame([("insert", "a", "en", "v", None, 3), ("upsert", "a", "en", "v", None, 3)], schema))
    assert rollup.totals().count() == 0 and rollup.batches() == set()
    assert rollup.apply("x", spark.createDataFrame([("insert", "a", "en", "v", None, 3)], schema))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 1, 3)]
    with pytest.raises(ValueError):
        rollup.apply("../x", spark.createDataFrame([], schema))


def test_documents_without_tokens_count(spark, tmp_path):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one two", "en", "b"), (4, "", "en", "b"), (5, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in op1_token_counts(spark, str(tmp_path)).collect()}
    assert got == {("a", "en"): (2, 0), ("b", "en"): (2, 2), (None, None): (1, 0)}


def test_white_space_runs():
    from pathlib import Path

    encoding = tc._encoding("test", Path(tc.VOCABULARY).read_bytes())
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b1", " x", "!", "\n", " " * 600, "\n" * 700, "\t \u3000" * 300, "é", " ", "\xa0" * 501]) for _ in range(rng.randint(1, 9)))
        assert tc.text_tokens(encoding, text) == len(encoding.encode_ordinary(text))
    assert tc.text_tokens(encoding, " " * 1_000_000) > 0
    assert tc.text_tokens(encoding, "a" + "\n" * 1_000_000 + " b") > 2


def test_batch_that_commits_during_compaction(spark, tmp_path, monkeypatch):
    schema = "op string, source string, lang string, tokenizer string, tokens_before long, tokens_after long"
    rollup = tc.TokenRollup(spark, f"file://{tmp_path}/r")
    batch = lambda n: spark.createDataFrame([("insert", "a", "en", "v", None, n)], schema)
    for n in (1, 2):
        assert rollup.apply(f"b{n}", batch(n))
    sums = rollup._sums

    def meanwhile(tables):
        monkeypatch.setattr(rollup, "_sums", sums)
        assert rollup.apply("late", batch(40))
        return sums(tables)

    monkeypatch.setattr(rollup, "_sums", meanwhile)
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 3, 43)]
    rollup.compact()
    assert rollup.vacuum() >= 3 and [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 3, 43)]
    assert not rollup.apply("late", batch(40)) and rollup.apply("b3", batch(3))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 4, 46)]
    assert not rollup._commit("b3", "another writer")
