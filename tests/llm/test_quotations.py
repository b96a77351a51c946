"""Quotation linking against a plain reading of every conversation."""

import random
import re
import time

import duckdb
import pytest

from colsync.llm import quotations
from colsync.llm.queries import ORACLES, op6_quotations

SF = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "turn", "role", "content", "n_quotes", "max_level", "n_linked", "reply_to", "root_turn", "depth"]


def normal(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ")


def parse(text):
    out = []
    for line in re.sub("\r\n?", "\n", text or "").split("\n"):
        m = re.match(r"[ \t]*((?:>[ \t]?)+)", line)
        out.append((m.group(1).count(">") if m else 0, line[m.end() :] if m else line))
    return out


def own(text):
    return "\n".join(s for level, s in parse(text) if not level).strip(" \t\n\x0b\f\r")


def said(text):
    body = own(text)
    return {normal(t) for t in [body, *re.split(r"\n[ \t\n\x0b\f\r]*\n", body), *body.split("\n")]} - {""}


def passages(text):
    out, block = set(), []
    for level, says in [*parse(text), (0, "")]:
        if level:
            block.append((level, says))
            continue
        for k in {k for k, _ in block}:
            out.add((k, 0, normal(" ".join(s for n, s in block if n == k))))
        out |= {(k, 1, normal(s)) for k, s in block}
        block = []
    return {p for p in out if p[2]}


def brute(rows):
    best, counts, held = {}, {}, {}
    for conv, turn, _, text in rows:
        if conv is not None and turn is not None:
            for p in passages(text):
                held.setdefault((conv, turn), set()).add(p)
    for (conv, turn), found in held.items():
        for level, part, words in found:
            before = [t for c, t, _, x in rows if c == conv and t is not None and t < turn and words in said(x)]
            if before:
                counts[conv, turn] = counts.get((conv, turn), 0) + 1
                k = (level, part, -max(before))
                best[conv, turn] = min(best.get((conv, turn), k), k)
    out = []
    for conv, turn, role, text in rows:
        root, depth = turn, 0
        while (conv, root) in best:
            root, depth = -best[conv, root][2], depth + 1
        found = passages(text)
        reply = -best[conv, turn][2] if (conv, turn) in best else None
        out.append((conv, turn, role, own(text), sum(p[1] == 0 for p in found), max((p[0] for p in found), default=0), counts.get((conv, turn), 0), reply, root, depth))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_whole_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert got(op6_quotations(spark, SF)) == brute(rows)


@pytest.mark.parametrize("stretch", [256, 3])
def test_nested_quotes_and_edges(spark, monkeypatch, stretch):
    monkeypatch.setattr(quotations, "STRETCH", stretch)
    rng = random.Random(stretch)
    lines = ["Hello there", "how  are YOU", "ok", "", "fine, thanks", "another line", "ünïcode", "last one"]
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(rng.randint(1, 14)):
            parts = []
            for _ in range(rng.randint(1, 4)):
                if texts and rng.random() < 0.6:
                    quoted = rng.choice(texts).split("\n")
                    parts += [rng.choice([">", "> ", " >"]) + x for x in quoted[: rng.randint(1, 4)]]
                else:
                    parts += [rng.choice(lines) for _ in range(rng.randint(1, 3))]
            texts.append(rng.choice(["\n", "\n", "\r\n"]).join(parts))
            rows.append((conv, turn, "user", texts[-1]))
    rows += [(90, 0, "user", None), (90, 1, "user", ""), (90, 2, "user", "> "), (None, 1, "user", "> ok"), (91, None, None, "> ok"), (92, 1, "a", "ok"), (92, 1, "b", "> ok"), (92, 2, "a", "> ok"), (92, 2, "a", "> ok"), (93, 5, "x", ">>> deep\n>> less\n> one\nend"), (94, 0, "u", "w " * 40_000), (94, 7, "u", "> " + "W " * 40_000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, content string, hash string")
    found = got(quotations.link_quotations(df))
    assert found == brute(rows)
    assert any(r[-1] > 1 for r in found) and any(r[5] > 1 for r in found)
    plain_rows = [r for r in rows if None not in r[:2] and r[0] != 92]  # one row for each turn
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", plain_rows)
    rel = con.execute(ORACLES["op6_quotations"])
    names = [c[0] for c in rel.description]
    assert sorted((tuple(dict(zip(names, r, strict=True))[c] for c in COLUMNS) for r in rel.fetchall()), key=str) == brute(plain_rows)
    assert quotations.link_quotations(df.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(1, t, "u", "ok" if t % 3 else f"> ok\nreply {t}") for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.turn: r for r in quotations.link_quotations(df).collect()}
    assert all(out[t].reply_to == (t - 1 if t else None) for t in range(0, 1500, 3))


def test_long_quotes(spark):
    n = 100_000
    texts = ["hello", "> hello\n" * n, ">" * n, "> " * n + "hello", "\n".join(f"> line {i}" for i in range(n)), " " * n * 5 + "x" + " " * n * 5 + "\n> hello", "\n" * n * 3 + "end", ">" + " \n" * n]
    df = spark.createDataFrame([(1, i, "u", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").repartition(4)
    began = time.monotonic()
    out = {r.turn: r for r in quotations.link_quotations(df).collect()}
    assert time.monotonic() - began < 90
    assert len(out) == len(texts) and out[1].reply_to == 0 and out[5].reply_to == 0 and out[5].content == "x"
    assert out[3].max_level == n and out[2].n_quotes == 0 and out[4].n_quotes == 1 and out[6].content == "end"
