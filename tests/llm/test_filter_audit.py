"""The audit against every order applied document by document."""

import re
from itertools import permutations

import pytest

from colsync.llm import filter_audit, skew

SF = "/root/testdata/sf0.01"


def plain(rows, labels):
    """Each order applied to each document, one filter after the other."""
    first, good, toxic = {}, set(), set()
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    out, docs = {}, []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {"A"} if len(words) < 100 else set()
        failed |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        failed |= {"D"} if re.search("[#$%&*|]", t) else set()
        failed |= {"E"} if i is not None and i > first[t] else set()
        docs.append((lang or "", failed, i is not None and i in good, i is not None and i in toxic))
    for part in {p for p, *_ in docs}:
        mine, rows_, shapley = [d for d in docs if d[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for at, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                failing = [d for d in mine if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                rows_.append((part, "".join(order), at + 1, len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        for r in rows_:
            out[r[:3]] = (*r[3:], shapley[r[1][r[2] - 1]])
    return out


def got(df):
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    found = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_lattice():
    assert len(filter_audit.edges("ABCDE")) == 80 and len(filter_audit.steps("ABCDE")) == 600
    assert {(s, b) for _, _, s, b in filter_audit.steps("ABCDE")} == set(filter_audit.edges("ABCDE"))


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", m, m == 3, False, 2) for m in range(8)] + [("p", 0, True, True, 5)], "part string, mask int, good boolean, toxic boolean, n long")
    out = {(r.filter_order, r.step): r for r in filter_audit.audit_masks(cells, "xyz").collect()}
    assert len(out) == 18 and out["xyz", 1].removed == 8 and out["xyz", 1].good_lost == 2 and out["yxz", 2].redundant == 4 and out["zyx", 3].kept == 7
    assert out["xyz", 1].shapley == sum(out[o, o.index("x") + 1].removed for o in {o for o, _ in out})
    for bad in ("", "aa", "abcdefghi"):
        with pytest.raises(ValueError):
            filter_audit.audit_masks(cells, bad)


@pytest.mark.parametrize("hot", [1000, 3])
def test_edges(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT_SHARE", hot)
    long = " ".join(f"w{i}" for i in range(50_000))
    many = [" ".join(f"{c}{i}" for i in range(120)) for c in "abc"]
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t", None), (4, long, "en"), (5, long, "fr"), (6, many[0], ""), (6, many[0], ""), (7, many[0], None), (None, many[0], "en"), (8, many[1] + " #", "en"), (8, many[2] + " A" * 300, "en")]
    rows += [(9, "ÄÖÜ" * 40, "de"), (10, "AB" + "x" * 18, "de"), (11, "ABC" + "x" * 17, "de"), (12, " ".join(["x", "y"] * 60), "de"), (13, "tab\vfeed\fx", "de"), (14, "same", None)]
    rows += [(100 + i % 7, "copied " * 3, "hot") for i in range(300)] + [(200 + i, "copied " * 3, "hot") for i in range(300)]
    labels = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (8, None, 1), (8, 1, None), (5, 0, 0), (None, 1, 1), (205, 1, 1), (103, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*r, 5, "s") for r in rows], "doc_id long, text string, lang string, mask int, part string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(filter_audit.filter_audit(docs, known)) == plain(rows, labels)
    assert filter_audit.filter_audit(docs.limit(0), known).count() == 0
    assert got(filter_audit.filter_audit(docs.limit(8), known.limit(0))) == plain(rows[:8], [])


def test_whole_table(spark):
    from colsync.llm.queries import op13_filter_audit

    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    want = plain([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert got(op13_filter_audit(spark, SF)) == want and len(want) == 600 * docs.select("lang").distinct().count()
