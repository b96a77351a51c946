"""Base spans against plain patterns, the tagger's gradients against differences, and its recall on unseen lines."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from colsync.llm import pii
from colsync.llm.queries import op9_pii
from colsync.llm.tagger import Tagger, crf_loss

SF = "/root/testdata/sf0.01"


def plain(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def test_base_spans_on_odd_texts():
    rng = random.Random(2)
    pieces = ["a", "B9", "@", ".", "@x.", "+", "+4", "1", "22", "256", "255", ".1", "-", " ", "(", ")", "%", "é", "\n", "4111 1111", "1111", "0", "00255.", "x@y.z"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain(text), text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_gradients():
    rng = np.random.default_rng(0)
    tagger = Tagger(7, 5, embedding=3, hidden=4, dtype=np.float64)
    tagger.params["move"] += rng.normal(0, 0.3, (5, 5))
    symbols, tags = rng.integers(0, 7, (6, 3)), rng.integers(0, 5, (6, 3))
    _, grads = tagger.loss(symbols, tags)
    for name, value in tagger.params.items():
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(4)]:
            keep = value[at]
            value[at] = keep + 1e-5
            up = tagger.loss(symbols, tags)[0]
            value[at] = keep - 1e-5
            down = tagger.loss(symbols, tags)[0]
            value[at] = keep
            assert np.isclose((up - down) / 2e-5, grads[name][at], atol=1e-6), name


def test_crf_sums_and_viterbi_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    tagger = Tagger(4, 3, embedding=2, hidden=2, dtype=np.float64)
    tagger.params["move"] = rng.normal(0, 1, (3, 3))
    symbols = rng.integers(0, 4, (5, 1))
    score, move = tagger.emissions(symbols), tagger.params["move"]
    value = lambda p: sum(score[t, 0, k] for t, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False))
    paths = list(product(range(3), repeat=5))
    best = max(paths, key=value)
    assert tuple(tagger.decode(symbols)[:, 0]) == best
    want = np.log(sum(np.exp(value(p)) for p in paths)) - value(best)
    assert np.isclose(crf_loss(score, move, np.array(best)[:, None])[0], want)


def test_tagger_on_unseen_lines():
    rng = random.Random(99)
    hit = total = wrong = found_all = 0
    for _ in range(400):
        text, spans = pii.labelled_line(rng)
        pad = "word " * rng.randint(0, 30)
        written = {(k, x - len(pad), y - len(pad)) for k, x, y in pii.tagged(pii.model(), [pad + text])[0]}
        want = {s for s in spans if pii.plausible(s[0], text[s[1] : s[2]])}
        hit += len(want & written)
        total += len(want)
        wrong += len(written - want)
        found_all += len(written)
    assert hit / total >= 0.9 and wrong / found_all < 0.1


def unmarked(line):
    """The text of a marked line, and its spans."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"<<(\w+)\|(.+?)>>", line):
        text += line[at : m.start()]
        spans.append((pii.KINDS.index(m.group(1)), len(text), len(text) + len(m.group(2))))
        text, at = text + m.group(2), m.end()
    return text + line[at:], spans


def test_recall_and_precision_on_lines_by_hand():
    from tests.llm.pii_lines import CLEAN, MARKED

    hit = total = wrong = 0
    for line in [*MARKED, *CLEAN]:
        text, spans = unmarked(line)
        for pad in ("", "Some words stand before it. " * 5):
            _, [found] = pii.find_spans(pii.model(), pa.array([pad + text]))
            written = {(k, a - len(pad), b - len(pad)) for k, a, b in found}
            total += len(spans)
            hit += sum(any(k == kind and a < y and x < b and (min(b, y) - max(a, x)) >= 0.8 * (max(b, y) - min(a, x)) for k, x, y in written) for kind, a, b in spans)
            wrong += sum(not any(x < b and a < y for _, x, y in spans) for _, a, b in written)
    assert hit / total >= 0.9 and wrong <= 0.1 * hit, (hit, total, wrong)


def test_windows_cover_every_trigger():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("abc  9@") if rng.random() < 0.05 else "x" for _ in range(rng.randint(0, 700)))
        starts = pii.windows(text)
        for m in re.finditer("[0-9@]", text):
            for length in (1, 20, pii.STRIDE):
                for a in {max(0, m.start() - length + 1), m.start()}:
                    b = min(len(text), a + length)
                    assert any(s <= a and b <= s + pii.WINDOW for s in starts)


def test_reconcile():
    assert pii.reconcile([(1, 5, 10)], [(0, 8, 12), (0, 20, 25), (3, 22, 40), (2, 12, 15), (3, 22, 40)]) == [(1, 5, 10), (2, 12, 15), (3, 22, 40)]


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    extra = 0
    for r in rows:
        base = plain(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.join_spans(base).encode()).hexdigest()
        all_ = [s for s in r.spans.split(",") if s]
        assert set(pii.join_spans(base).split(",")) - {""} <= set(all_)
        extra += len(all_) - len(base)
    assert extra <= 0.1 * sum(len(plain(t)) for t in docs.values())


@pytest.mark.parametrize("text", ["call (212) 555-0187 now", "write to joe.smith [at] mail.example [dot] org please"])
def test_added_spans(text):
    assert pii.tagged(pii.model(), ["pad " * 40 + text])[0]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co"), (None, "+1 (543) 555-9258"), (5, "1 " * 60_000), (6, "é" * 50_000 + " x@y.zz"), (7, "9" * 100_000)]
    df = spark.createDataFrame([(a, t, "clash") for a, t in rows], "doc_id long, text string, spans string")
    out = pii.personal_data(df).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_phone) for r in out) == [(0, 0, 1), (1, 0, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0), (5, 0, 0), (6, 1, 0), (7, 0, 0)]
    assert pii.personal_data(df.limit(0)).count() == 0
    assert pii.mask("to a@b.co and 1.2.3.4.", "email:3:9,ip:14:21") == "to [email] and [ip]."
