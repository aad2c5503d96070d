import random

import pytest

from relinker.llm import decontaminate, registry


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row), row.index(min(row))


@pytest.mark.parametrize("seed", range(30))
def test_myers(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    pattern, text = make(rng.randint(1, 90)), make(rng.randint(0, 120))
    best, end = decontaminate.best_match(pattern, text)
    assert best == slow_distance(pattern, text)[0]
    if best < len(pattern):
        assert slow_distance(pattern, text[:end])[0] == best


def test_pigeonhole_misses_nothing(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 40)))) for i in range(25)]
    docs = []
    for d in range(120):
        text = list(" ".join(word() for _ in range(60)))
        if d % 2:
            item = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(item) // 14))):
                item[rng.randrange(len(item))] = rng.choice(["", "x", "yz"])
            at = rng.randrange(len(text))
            text[at:at] = [" ", *item, " "]
        docs.append((d, "".join(text)))
    want = set()
    for d, text in docs:
        for i, item in items:
            pattern = decontaminate.normal(item)
            got = slow_distance(pattern, decontaminate.normal(text))[0]
            if got <= int(len(pattern) * 0.08):
                want.add((d, i, got))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (4_000_000, 500):
        got = decontaminate.contamination(df, bench, block_bytes=block_bytes).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == sorted(want)
    left = {r.doc_id for r in decontaminate.drop_contaminated(df, bench, block_bytes=500).collect()}
    assert left == {d for d, _ in docs} - {d for d, _, _ in want} and len(want) > 20


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    bench = {r.item_id: decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {r.doc_id: decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.op10_decontamination(spark, sf).collect()
    exact = {(d, i) for d, t in texts.items() for i, b in bench.items() if b in t}
    assert exact == {(r.doc_id, r.item_id) for r in got if r.distance == 0} and exact
    for r in got:
        limit = int(len(bench[r.item_id]) * 0.08)
        window = texts[r.doc_id][max(0, r.end - len(bench[r.item_id]) - limit) : r.end]
        assert slow_distance(bench[r.item_id], window)[0] == r.distance <= limit


def test_edges(spark):
    items = spark.createDataFrame([(1, "A passage, of the test!"), (1, "a passage of the test"), (2, None), (3, " ?! "), (None, "other")], "item_id long, text string")
    rows = [(1, None, 0), (2, "", 0), (3, "x A PASSAGE of  the-test y", 0), (None, "a passage of the test", 0), (5, "w " * 90_000 + "a passage of the text", 0), (6, "other", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in decontaminate.contamination(df, items).collect())
    assert got == [(0, 1, 0)] * 2 + [(3, 1, 0)] * 2 + [(5, 1, 1)] * 2
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, items).collect()) == [1, 2, 6]
    assert decontaminate.contamination(df.limit(0), items).collect() == []
    assert decontaminate.contamination(df, items.limit(0)).collect() == []


def test_tiny_items_match_exactly_and_inside_words(spark):
    docs = spark.createDataFrame([(1, "The cathedral."), (2, "THE CAT"), (3, "the cst"), (4, "cat the")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the cat")], "item_id long, text string")
    assert {(r.doc_id, r.distance) for r in decontaminate.contamination(docs, items).collect()} == {(1, 0), (2, 0)}
