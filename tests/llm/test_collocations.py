"""Collocations against counting by hand, with prefixes dealt deeper and buckets dealt again."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from colsync.llm import collocations

SF = "/root/testdata/sf0.01"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        ranked = []
        for p, a in candidates.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def sample(n, seed=5):
    rnd = random.Random(seed)
    common, rare = ["the", "of", "a", "Über", "ça", "x"], [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = [rnd.choice(common) if rnd.random() < 0.7 else rnd.choice(rare) for _ in range(rnd.randrange(40))]
        rows.append((rnd.choice([" ", "\t ", ", "]).join(words) + rnd.choice([".", "!\n", " "]), rnd.choice(["en", "en", None, "fr", ""])))
    fixed = "we hold THESE truths to be self-evident, that all; men\x0bare\x0ccreated  equal"
    return rows + [(fixed, "en")] * 60 + [(fixed, "de")] * 30 + [(fixed, "it")] * 29 + [("a b a b a b " * 400, "loop"), ("né e né e née x " * 90, "fr"), (None, "en"), ("", None), (" .,\t", "zz")]


def test_whole_table(spark):
    from colsync.llm.queries import op12_collocations

    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(op12_collocations(spark, SF)) == plain(rows)


@pytest.mark.parametrize("share,least,most,size", [(4096, 4096, 1 << 21, 8 << 20), (50, 1, 1 << 21, 3000), (4096, 4096, 40, 2000), (30, 1, 25, 500)])
def test_deep_prefixes_and_large_buckets(spark, monkeypatch, share, least, most, size):
    for name, value in (("HOT_SHARE", share), ("HOT_LEAST", least), ("MAX_CONTEXTS", most), ("SLICE_BYTES", size), ("MIN_BUCKETS", 8)):
        monkeypatch.setattr(collocations, name, value)
    rows = sample(600)
    df = spark.createDataFrame([(i, *r, 1, "p") for i, r in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase string").repartition(6)
    assert got(collocations.mine(df)) == plain(rows)
    assert got(collocations.mine(df, top=7)) == plain(rows, top=7)
    assert collocations.mine(df.limit(0)).count() == 0


def test_exact_beyond_64_bits(spark):
    big = 6 * 10**15
    rows = [("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, 9 * 10**18), ("en", "c d", 2, 40), ("en", "c", 1, 50), ("en", "d", 1, 70)]
    out = {r.phrase: (r.l, r.r, r.score) for r in collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, a long")).collect()}
    assert out == {"a b": (big + 7, 9 * 10**18, 2000000 * big // (big + 7 + 9 * 10**18)), "c d": (50, 70, 2000000 * 40 // 120)}


def test_blocks():
    texts = ["a b c a b", "", "né a b. A  B", "z" * 300, "b a"]
    data = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    c, per_text = collocations.contexts(np.frombuffer(data, np.uint8), at, ["fr", "en"], np.array([0, 0, 1, 1, 0]))
    assert per_text.tolist() == [5, 0, 5, 1, 2]

    def rows(c):
        word = lambda t: None if t == 0 else (c.langs[c.lang[t - 1]], c.words[t - 1].as_py())
        return Counter({tuple(map(word, r)): int(n) for *r, n in zip(*c.columns, c.count, strict=True)})

    want = rows(c)
    assert want[("en", "a"), ("en", "b"), None, None] == 2 and sum(want.values()) == 13
    blocks = list(collocations.dealt(c, 3, [np.zeros(0, np.uint64)] * 4, 1, 0))
    back = [collocations.unpack(b) for _, _, b in blocks]
    assert sum((rows(b) for b in back), Counter()) == want == rows(collocations.merged(back))
    hashes = collocations.hash_strings(pa.array(["ab", "ba", "", "a", "ab"]))
    assert hashes[0] == hashes[4] and len(set(hashes.tolist())) == 4
