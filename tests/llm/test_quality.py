import zlib

import numpy as np

from relinker.llm import quality, registry

SF = "/root/testdata/sf0.01"


def test_held_out_ranking(spark):
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    rows = registry.op2_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good]) > 0.9


def test_token_rows():
    same = quality.token_rows("The cat, the\ncat,  x")
    assert len(same) == 7 and same[1] == same[4] and same[2] == same[5]
    assert len(quality.token_rows("")) == len(quality.token_rows(" \n")) == 0
    long = "some words and *** " * 60_000
    assert (quality.token_rows(long) == np.tile(quality.token_rows("some words and ***"), 60_000)).all()


def test_context_sums_against_a_loop():
    t = np.array([5, 9, 5, 7, -1, 9, 9, -1, 3, -1])
    want = np.zeros((quality.ROWS, quality.DIMS))
    for i, a in enumerate(t):
        for j in (i - 1, i + 1):
            if 0 <= j < len(t) and a >= 0 and t[j] >= 0:
                for p, s in zip(quality._PLACES[t[j]], quality._SIGNS[t[j]]):
                    want[a, p] += s
    assert np.array_equal(quality.context_sums(t), want)


def test_network_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-(x[:, 0] - x[:, 1])))
    y = (rng.random(4000) < p).astype(float)
    net = quality.fit(x[:3000], y[:3000])
    q = net.probability(x[3000:])
    assert np.corrcoef(q, p[3000:])[0, 1] > 0.9 and abs(q.mean() - y[3000:].mean()) < 0.05


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (7, "same text"), (7, "same text"), (8, "w " * 300_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (8, None), (None, 0), (7, 5)], "doc_id long, quality int")
    got = quality.quality_scores(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    same = {(r.score, r.predicted) for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1 and len({r.score for r in got if r.doc_id == 7}) == 1
    assert quality.quality_scores(df.limit(0), labels).collect() == []
    assert len(quality.quality_scores(df, labels.limit(0)).collect()) == len(rows)


def test_repeated_labels_teach_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    one = sorted(map(tuple, quality.quality_scores(docs, labels).collect()))
    assert sorted(map(tuple, quality.quality_scores(docs, labels.union(labels).union(labels)).collect())) == one
