import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relinker.llm import merkle, registry

SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    say = lambda v: "-" if v is None else f"{len(str(v).encode('utf-8', 'surrogatepass'))}:{v}"
    return sha(*map(say, row))


def climb(nodes, at, claim):
    """Root, root with the claim, and the siblings of one leaf."""
    siblings = []
    value, nodes = claim, list(nodes)
    while len(nodes) > 1:
        a = at // 3 * 3
        run = nodes[a : a + 3]
        siblings += [h for i, h in enumerate(run) if a + i != at]
        value = sha(*(value if a + i == at else h for i, h in enumerate(run)))
        nodes, at = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], at // 3
    return nodes[0], value, siblings


def slow(rows, tamper):
    """rows: doc_id, source, lang, n_chars, text."""
    leaves = {}
    for r in rows:
        leaves.setdefault(r[1], []).append((r[0] is not None, r[0], leaf_of(r), leaf_of((*r[:4], tamper(r)))))
    order = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        leaves[s].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
    subroots = [climb([x[2] for x in leaves[s]], 0, "")[0] for s in order]
    out = []
    for i, s in enumerate(order):
        for at, (_, doc, leaf, claim) in enumerate(leaves[s]):
            _, value, one = climb([x[2] for x in leaves[s]], at, claim)
            root, value, two = climb(subroots, i, value)
            out.append((doc, leaf, subroots[i], root, sha(*one, *two), value, value == root))
    return sorted(out, key=str)


def without_newlines(row):
    even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
    return row[4].replace("\n", "") if even and row[4] is not None else row[4]


def run(df, **kw):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    change = lambda name, v: F.when(even, F.replace(v, F.lit("\n"), F.lit(""))).otherwise(v) if name == "text" else v
    return sorted(map(tuple, merkle.manifest(df, replace=change, **kw).collect()), key=str)


def test_whole_table(spark, same_as_sql):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    found = registry.op12_merkle(spark, SF)
    assert sorted(map(tuple, found.collect()), key=str) == slow([tuple(r) for r in rows], without_newlines)
    assert {r.verified for r in found.collect()} == {True, False}
    same_as_sql(found, registry.ORACLE["op12_merkle"], SF)


def test_blocks_against_hashlib():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 2**32, (50, 8), np.uint32)
    text = merkle.to_hex(digests)
    assert (merkle.to_words(text) == digests).all()
    for many in range(1, 20):
        parents = merkle.Parents(digests[:many])
        assert merkle.to_hex(parents.digests) == [sha(*text[i : min(i + 3, many)]) for i in range(0, many, 3)]


def test_folding_reads_right_siblings_only():
    rng = np.random.default_rng(2)
    digests = rng.integers(0, 2**32, (8, 8), np.uint32)
    steps = merkle.Parents(digests).steps(np.arange(8))
    steps.children = steps.children.copy()
    for i, slot in enumerate(steps.slot):
        steps.children[i, : slot + 1] = 0  # what stands left, and the old child, is not needed
    new = rng.integers(0, 2**32, (8, 8), np.uint32)
    text, changed = merkle.to_hex(digests), merkle.to_hex(new)
    want = []
    for i in range(8):
        run = text[i // 3 * 3 : i // 3 * 3 + 3]
        run[i % 3] = changed[i]
        want.append(sha(*run))
    assert merkle.to_hex(steps.fold(new)) == want


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_edges_and_rounds(spark, depth):
    """Chunks of 3 and 9 nodes give the trees that large chunks give; odd rows in all columns."""
    rng = random.Random(depth)
    rows = [(i, rng.choice(["hot"] * 9 + ["b", "é", None]), rng.choice(["en", None]), i, f"text {i}\nmore") for i in range(60)]
    rows += [(7, "hot", "en", 1, "same id"), (7, "hot", "en", 1, "same id"), (7, "b", None, None, None), (None, "b", "en", 0, ""), (None, None, None, None, None)]
    rows += [(1000, "", "", -5, "\n" * 5000), (1001, "alone", "en", 2, "x" * 300_000 + "\n"), (1002, "Z", "en", 2, "ü\n")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, n int, grp string")
    assert run(df, depth=depth) == slow(rows, without_newlines)


def test_few_rows(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    one = [(5, "s", "en", 1, "a\nb")]
    assert run(spark.createDataFrame(one, kind)) == slow(one, without_newlines)
    assert run(spark.createDataFrame([], kind)) == []
