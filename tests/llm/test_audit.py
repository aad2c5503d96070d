import random
import re
from collections import Counter

import pyarrow as pa

from relinker.llm import audit, registry

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(rows, least, top):
    """rows: lang, source, text."""
    n, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", terms_of(text)
        groups.add((lang, source))
        n.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        vocab = [t for (x, t), d in docs.items() if x == lang and d >= least]
        share = lambda counts: {t: 1 + 10**9 * (c + 5) // (sum(counts.values()) + 5 * len(vocab)) for t, c in counts.items()}
        p = {s: share({t: n[lang, s, t] for t in vocab}) for s in sources}
        q = share({t: sum(n[lang, s, t] for s in sources) for t in vocab})
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in vocab), o.encode(), o) for o in sources if o != s]
            more = [(q[t] - p[s][t], t.encode(), t) for t in vocab if n[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def test_whole_table(spark, same_as_sql):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text").collect()
    found = registry.op13_divergence(spark, SF)
    assert sorted(map(tuple, found.collect())) == slow([tuple(r) for r in rows], 30, 50)
    same_as_sql(found, registry.ORACLE["op13_divergence"], SF)


def test_term_counts():
    batch = pa.table({"lang": ["a", "a", "b"], "source": ["s", "s", ""], "text": ["It's IT, Été été 3x", "it", ""]})
    got = {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in audit.term_counts(batch).to_pylist()}
    assert got == {
        ("a", "s", ""): (0, 0), ("b", "", ""): (0, 0), ("a", "s", "it"): (3, 2), ("a", "s", "s"): (1, 1),
        ("a", "s", "Été"): (1, 1), ("a", "s", "été"): (1, 1), ("a", "s", "x"): (1, 1),
    }


def test_edges_and_blocks(spark):
    """Nulls, empty texts, ties, a very long text, repeated rows, more sources than a block has, extra columns."""
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "délta", "ω", "zeta", "eta"]
    rows = [("en", f"s{rng.randrange(150)}", " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(600)]
    rows += [("en", "s1", "alpha beta")] * 40 + [(None, None, None), (None, "s", ""), ("", None, "eta eta"), ("xx", "one", "eta"), ("xx", "two", "123")]
    rows += [("en", "long", "word " * 200_000 + "alpha"), ("en", "mute", "...")]
    df = spark.createDataFrame([(i, *r, 1, "t") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n int, term string")
    got = sorted(map(tuple, audit.divergences(df, least=3, top=4).collect()))
    assert got == slow(rows, 3, 4) and len({r[1] for r in got if r[0] == "en"}) > 2 * audit.BLOCK
    assert audit.divergences(df.limit(0)).collect() == []


def test_large_counts_stay_exact(spark):
    big = 4 * 10**12
    df = spark.createDataFrame([(big, 9 * 10**14, 7), (0, 1, 1)], "n long, total long, v long")
    got = [r[0] for r in df.select(audit._share("n", "total", "v")).collect()]
    assert got == [1 + 10**9 * (big + 5) // (9 * 10**14 + 35), 1 + 10**9 * 5 // 6]
