import re

import corpus_pipeline
from relinker.llm import decontaminate, quality, simhash
from tests.llm.test_packing import check_bins
from tests.llm.test_secrets import base_spans

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    both = len(a & b)
    return both / max(1, len(a) + len(b) - both)


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    for step in steps[1:-1]:
        assert step.columns == docs.columns
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:-1]]

    scores = quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(rows[1]) == {r.doc_id for r in scores if r.predicted == 1} and 0 < len(rows[1]) < len(rows[0])

    sets = {d: set(simhash.shingle_set(r.text, 5).tolist()) for d, r in rows[1].items()}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sorted(sets):
        for b in sets:
            if b < a and (jaccard(sets[a], sets[b]) >= 0.8 or sets[a] == sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    assert set(rows[2]) == {d for d in sets if find(d) == d}

    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = lambda text: any(decontaminate.best_match(i, decontaminate.normal(text))[0] <= int(len(i) * 0.08) for i in items)
    assert set(rows[3]) == {d for d, r in rows[2].items() if not near(r.text)} and len(rows[3]) < len(rows[2])

    assert set(rows[4]) == set(rows[3])
    for d, r in rows[4].items():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        if not base_spans(rows[3][d].text):
            assert r.text == rows[3][d].text or re.search("[A-Za-z0-9+/_=-]{16}", rows[3][d].text)
    last = steps[-1].collect()
    assert {r.doc_id for r in last} == set(rows[4])
    check_bins(last, 2048)


def test_run_keeps_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    one, two = docs.drop("sequence_id", "offset"), corpus_pipeline.run(spark, SF).drop("sequence_id", "offset")
    assert sorted(one.collect()) == sorted(two.collect())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_odd_documents(spark):
    """Nulls in every column, repeated rows, one id with two texts, a very long text, and further columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    good = max((r.text for r in docs.collect() if r.text and len(r.text) < 4000), key=len)
    rows = [
        (None, None, None, None, None), (10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (None, good + " null id", "en", "s", 9),
        (10**6 + 2, good + " twice", "en", "s", 9), (10**6 + 2, good + " twice", "en", "s", 9),
        (10**6 + 3, " ".join(f"word{i} of text" for i in range(60)), "en", "s", 1), (10**6 + 3, " ".join(f"other{i} has words" for i in range(60)), "en", "s", 1),
        (10**6 + 4, " ".join(f"{w}{i}" for i in range(400) for w in good.split()[:200]), "en", "s", 1),
    ]
    odd = docs.union(spark.createDataFrame(rows, docs.schema))
    more = odd.selectExpr("*", "1 AS node", "'x' AS tag", "2 AS piece", "3 AS length", "'k' AS base", "0 AS runs", "1 AS label", "'y' AS vector")
    step = more
    for name, stage in corpus_pipeline.STAGES:
        before = step.count()
        step = stage(spark, step, SF).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert step.columns == more.columns and step.count() <= before
    check_bins(step.collect(), 2048)
    kept = corpus_pipeline.STAGES[1][1](spark, odd.filter("doc_id >= 1000000 OR doc_id IS NULL"), SF).collect()
    assert sum(r.doc_id is None for r in kept) == 2 and sum(r.doc_id == 10**6 + 3 for r in kept) == 2
