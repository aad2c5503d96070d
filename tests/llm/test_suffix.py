import hashlib
import random

import numpy as np
import pytest

from relinker.llm import registry, suffix


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 400))
    text = rng.integers(0, 256 if seed % 3 == 0 else 2, n).astype(np.uint8)
    if seed % 4 == 1:
        text = np.tile(text[:37], 12)
    data = text.tobytes()
    order = suffix.suffix_array(text)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    got = suffix.common_prefixes(text, order, 60)
    for k in range(len(data)):
        a, b = data[order[k] :], data[order[k - 1] :] if k else b""
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got[k] == min(want, 60)


@pytest.mark.parametrize("shard", [30, 200, 10**6])
def test_least_documents(shard):
    rng = random.Random(shard)
    base = [bytes(rng.choices(b"ab", k=60)) for _ in range(4)]
    pieces = [bytes(b[i:j]) for b in base for i, j in ((0, 60), (5, 40), (20, 60), (0, 12)) for _ in range(2)]
    docs = [rng.randrange(50) for _ in pieces]
    least = {}
    for p, d in zip(pieces, docs):
        for i in range(len(p) - 9):
            least[p[i : i + 10]] = min(d, least.get(p[i : i + 10], d))
    want = [least[p[i : i + 10]] for p in pieces for i in range(len(p) - 9)]
    got = suffix.least_documents(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), np.array(docs), 10, shard)
    assert got.tolist() == want


def slow(docs, length=50):
    first, out = {}, {}
    data = {k: (t or "").encode() for k, t in enumerate(t for _, t in docs)}
    ids = [d for d, _ in docs]
    for k, b in data.items():
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if ids[k] is not None:
                first[s] = min(ids[k], first.get(s, ids[k]))
    for k, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if ids[k] is not None and first[b[i : i + length]] < ids[k]:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.setdefault(ids[k], []).append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in registry.op5_substrings(spark, sf).collect()}
    assert got == slow(docs)


@pytest.mark.parametrize("hot", [2, 20_000])
def test_planted(spark, hot):
    rng = random.Random(hot)
    make = lambda n: "".join(rng.choices("abcdé fgh\n", k=n))
    passage, line = make(400), make(90)
    docs = []
    for d in range(60):
        text = make(rng.randrange(300))
        if d % 3:
            a = rng.randrange(200)
            text += passage[a : a + rng.randint(30, 200)]
        if d % 2:
            text += line + make(20)
        docs.append((d * 7 - 50, text))
    docs += [(500, "ab" * 400), (501, "ab" * 300), (502, None), (503, ""), (None, line), (500, docs[5][1]), (500, docs[5][1]), (9, "x" * 49 + "y" * 49)]
    docs += [(10**12, make(70_000) + passage)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, tag string")
    got = {}
    for r in suffix.substring_dedup(df, hot=hot, shard=3000).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == slow(docs)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.substring_dedup(df).collect() == []
