"""Compression classification against plain compression of whole texts, and its held-out accuracy."""

import random
import re
import zlib

import pyarrow as pa
import pytest
import zstandard

from colsync.llm import language_id
from colsync.llm.queries import op11_language_id

SF = "/root/testdata/sf0.01"


def plain(text, content):
    """Best language and margin of one text, with compressors made anew and the text cut by hand."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    t = re.sub(r"[\W\d_]+", " ", text.lower()).strip().encode()
    n = -(-len(t) // language_id.PART_BYTES)
    step = -(-len(t) // n)
    for kind in (language_id.QUICK, language_id.SLOW):
        sizes = {}
        for lang, c in content.items():
            params = zstandard.ZstdCompressionParameters(**kind)
            held = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            cctx = zstandard.ZstdCompressor(compression_params=params, dict_data=held)
            sizes[lang] = sum(len(cctx.compress(t[i * step : (i + 1) * step])) for i in range(n))
        best, second = sorted(sizes.values())[:2]
        if 1 - best / second >= language_id.MARGIN:
            break
    return min(lang for lang in sizes if sizes[lang] == best), 1 - best / second


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    out = op11_language_id(spark, SF).collect()
    assert len(out) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    content = language_id.learn(docs)
    for r in out[::7]:
        lang, score = plain(rows[r.doc_id].text, content)
        assert (r.lang_pred, r.score, r.rejected) == (lang, pytest.approx(score), score < language_id.MARGIN)
    held = [r for r in out if r.held_out]
    right = [r.lang_pred == rows[r.doc_id].lang for r in held]
    sure = [r.lang_pred == rows[r.doc_id].lang for r in held if not r.rejected]
    assert sum(right) >= 0.96 * len(right) and sum(sure) >= 0.97 * len(sure) and len(sure) >= 0.95 * len(held)


def test_held_out_documents_and_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    held = language_id.held_out(docs["doc_id"])
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.when(held, F.upper("text")).otherwise(F.col("text")))
    assert language_id.learn(docs) == language_id.learn(other) == language_id.learn(docs.repartition(7))
    assert "xx" not in {r.lang_pred for r in language_id.identify(other).collect()}


def test_bounds_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_PIECES", 5)
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    rows = [(i, f"only word{i % 7} here " * 40, "aa") for i in range(900)] + [(2000 + i, "altri testi qui " * 30, "bb") for i in range(300)] + [(5000 + i, "rare", "cc") for i in range(20)] + [(77, "one id " * 9, "aa")] * 500
    found = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(found) == ["aa", "bb"] and all(200 < len(c) <= 5 * 257 for c in found.values())


def test_edges(spark):
    rnd = random.Random(3)
    say = {lang: [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(40)] for lang, words in (("en", ["the", "reading", "of", "water", "house"]), ("fi", ["talo", "vesi", "lukea", "ja", "onko"]))}
    rows = [(i * 10 + k, t, lang) for k, (lang, texts) in enumerate(say.items()) for i, t in enumerate(texts)]
    odd = [(1001, None, "en"), (1002, "", "fi"), (1003, " 12 $%& \n", "en"), (1004, say["fi"][0] * 3000, None), (1005, "TALO, Vesi! JA; lukea onko talo vesi", None), (None, "reading the house of water", None), (1006, "q", "en"), (1006, "talo ja vesi onko lukea", None), (1006, "talo ja vesi onko lukea", None)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows + odd], "doc_id long, text string, lang string, score double, lang_pred string")
    out = language_id.identify(df).collect()
    found = sorted(((r.doc_id, r.lang_pred) for r in out if r.doc_id is None or r.doc_id > 1000), key=str)
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    assert [f for f in found if f[0] != 1006] == [(1001, "und"), (1002, "und"), (1003, "und"), (1004, "fi"), (1005, "fi"), (None, "en")]
    assert [f[1] for f in found if f[0] == 1006].count("fi") == 2
    assert language_id.identify(df.limit(0)).count() == 0
    alone = language_id.identify(df.where("lang = 'fi' AND text <> ''")).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in alone} == {("fi", 1.0, False)}
    from pyspark.sql import functions as F

    none = language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in none} == {("und", 0.0, True)}


def test_parts_are_whole():
    for n in (0, 1, 2047, 2048, 2049, 10_000):
        cut = language_id.parts(b"x" * n)
        assert sum(map(len, cut)) == n and all(0 < len(p) <= 2048 for p in cut) and len(cut) == -(-n // 2048)
    assert language_id.normalised(pa.array(["Ab-C1É", None, "  "])).to_pylist() == ["ab c é", "", ""]
