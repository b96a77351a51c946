"""The factorisation machine against plain sums, its gradients against differences, and held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa

from colsync.llm import quality
from colsync.llm.queries import op7_quality

SF = "/root/testdata/sf0.1"


def small_machine(seed=0):
    rng = np.random.default_rng(seed)
    width = quality.BUCKETS + len(quality.STATISTICS)
    n = len(quality.STATISTICS)
    return quality.FactorisationMachine(0.3, rng.normal(0, 0.3, width), rng.normal(0, 0.3, (width, quality.RANK)), rng.normal(0, 0.1, n), np.ones(n))


TEXTS = ["One two two THREE!\nfour | five", "", None, "word " * 300, "éa öb 12 34\n\n12 34"]


def test_linear_time_score_is_the_sum_over_pairs():
    machine = small_machine()
    f = next(quality.features(pa.array(TEXTS, pa.string())))
    for r, got in enumerate(machine.margins(f)):
        x = np.zeros(quality.BUCKETS + len(quality.STATISTICS))
        x[f.column[f.row == r]] = f.value[f.row == r] * 4.0
        x[quality.BUCKETS :] = np.clip((f.dense[r] - machine.mean) / machine.scale, -5, 5)
        on = np.flatnonzero(x)
        want = machine.bias + x @ machine.linear
        for i, a in enumerate(on):
            for b in on[i + 1 :]:
                want += machine.factors[a] @ machine.factors[b] * x[a] * x[b]
        assert np.isclose(got, want)


def test_gradients():
    machine = small_machine(1)
    f = next(quality.features(pa.array(TEXTS, pa.string())))
    good, weight = np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 1, 2, 1])
    _, linear, factors = quality._gradients(machine, f, good, weight)

    def loss():
        p = machine.scores(f)
        return -(weight * (good * np.log(p) + (1 - good) * np.log(1 - p))).mean()

    for array, grad, decay in ((machine.linear, linear, 1e-5), (machine.factors, factors, 1e-4)):
        for j in (int(f.column[0]), int(f.column[-1]), quality.BUCKETS, quality.BUCKETS + 3):
            at = (j,) if array.ndim == 1 else (j, 2)
            keep = array[at]
            array[at] = keep + 1e-5
            up = loss()
            array[at] = keep - 1e-5
            down = loss()
            array[at] = keep
            assert np.isclose((up - down) / 2e-5 + decay * keep, grad[at], rtol=1e-3, atol=1e-7)


def test_held_out_accuracy(spark):
    rows = op7_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.98


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*TEXTS, "a" * 200_000, "b c " * 400_000])] + [(3, "other", "x"), (None, "n", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (2, 0), (3, 0), (3, 1), (4, None), (5, 7), (None, 1), (6, 1)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(r.score is not None for r in out)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_clashing_columns_and_ids(spark):
    names = ["_id", "_label", "_text", "label", "id", "column", "value", "score", "_ID"]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        rows = [(k % 40 if k % 9 else None, "Good words in a line.\n" * 9 if k % 2 else "1 | 2 | 3 $$ " * 20, *[777] * len(names)) for k in range(80)] + [(81, None, *[777] * len(names)), (82, "", *[777] * len(names))]
        df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
        labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int").selectExpr("*", "1 AS `_id`", "1 AS `_text`")
        out = quality.accepted(df, labels).collect()
        assert len(quality.classify(df, labels).collect()) == len(rows)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert 0 < len(out) < len(rows) and all(r[n] == 777 for r in out for n in names)
