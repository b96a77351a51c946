"""Decontamination against a brute-force search for every window."""

import hashlib
import re

import pytest

from colsync.llm import decontaminate
from colsync.llm.queries import op5_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, spans string, item string"
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    want = brute(docs, items)
    assert got(op5_decontaminate(spark, SF)) == want
    assert any(v[4] for v in want.values())


@pytest.mark.parametrize("most", [2_000_000, 15])
def test_edges(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", most)
    ten = "one two three four five six seven eight nine ten"
    items = [(1, ten), (2, ten + " eleven"), (3, "Short item"), (4, None), (5, ""), (6, "the the the the the the the the the the the the"), (7, "éa öb ßc"), (10, "single"), (11, ten.upper())]
    docs = [
        (1, "x " + ten.replace(" ", ", ") + ". y"),
        (2, "a short-item here, and Single"),
        (3, None),
        (4, ""),
        (5, "the " * 500),
        (6, "the " * 9),
        (7, ("pad " * 3 + ten + " eleven ") * 40),
        (8, "ÉA éa öb ßc"),
        (9, "one two three four five six seven eight nine"),
        (10, "filler " * 60_000 + ten),
    ]
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate.digest(decontaminate.contaminated_spans(d, b))) == brute(docs, items)
    assert {r.doc_id for r in decontaminate.without_contaminated(d, b).collect()} == {3, 4, 6, 9}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([("x", "a b")], "item_id string, text string")
    assert decontaminate.contaminated_spans(d.limit(0), b).count() == 0
    assert [r.contaminated for r in decontaminate.digest(decontaminate.contaminated_spans(d, b.limit(0))).collect()] == [False]


@pytest.mark.parametrize("most", [2_000_000, 15])
def test_rows_without_own_ids(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", most)
    ten = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(None, ten), (None, "clean"), (1, "a " + ten + " b short item"), (1, "x y"), (1, "x y")], "doc_id long, text string")
    b = spark.createDataFrame([(1, ten), (2, ten.upper() + " eleven"), (3, "short item"), (4, "z " * 12)], "item_id long, text string")
    rows = decontaminate.digest(decontaminate.contaminated_spans(d, b)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in rows) == [(0, 1, 0, 0), (0, 10, 10, 2), (1, 2, 0, 0), (1, 2, 0, 0), (1, 14, 12, 3)]
