"""Runs of repeated words, against a plain version that follows each unit by comparing words."""

import random
import re
from collections import Counter, defaultdict

from relinker.llm import lines, registry
from relinker.llm.common import saved

WORD = re.compile("[^ \t-\r]+")
SCHEMA = "doc_id long, text string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def slow_runs(docs, rows):
    """``(doc, start, end, words)`` of ids with one text each, from the rows of ``repeated_units``; and each word's earlier place."""
    at = {d: [m.span() for m in WORD.finditer(t or "")] for d, t in docs.items()}
    words = {d: [low(t[a:b]) for a, b in at[d]] for d, t in docs.items()}
    index = {d: {a: i for i, (a, _) in enumerate(at[d])} for d in docs}
    inside = lambda d, a, z: [i for i, (x, y) in enumerate(at[d]) if a <= x and y <= z]
    spans, kept, source = defaultdict(set), defaultdict(set), defaultdict(dict)
    for r in rows:
        here = inside(r.doc_id, r.start, r.end)
        a, z = here[0], here[-1] + 1
        k = next(i for i in range(len(at[r.kept_doc_id])) if at[r.kept_doc_id][i][0] >= r.kept_start)
        kept[r.kept_doc_id].add((k, k + z - a))
        shift, mine, theirs = k - a, words[r.doc_id], words[r.kept_doc_id]
        if r.kind == "passage":
            floor, left, right = (k + z - a if r.doc_id == r.kept_doc_id else 0), 0, 0
            while left < lines.BESIDE and a > floor and a + shift > 0 and mine[a - 1] == theirs[a - 1 + shift]:
                a, left = a - 1, left + 1
            while right < lines.BESIDE and z < len(mine) and z + shift < len(theirs) and mine[z] == theirs[z + shift]:
                z, right = z + 1, right + 1
        spans[r.doc_id].add((a, z))
        for i in range(a, z):
            source[r.doc_id].setdefault(i, (r.kept_doc_id, i + shift))
            assert mine[i] == theirs[i + shift]
    out, whole = set(), {}
    for d, some in spans.items():
        covered = {i for a, z in some for i in range(a, z)}
        whole[d] = {(a, z) for a, z in kept[d] if not covered.issuperset(range(a, z))}
        stays = {i for a, z in whole[d] for i in range(a, z)}
        gone = sorted(covered - stays)
        for i in gone:
            if i - 1 not in gone:
                j = i
                while j + 1 in gone:
                    j += 1
                out.add((d, at[d][i][0], at[d][j][1], j + 1 - i))
    assert all(index[d][a] >= 0 for d, a, _, _ in out)
    return out, source, whole, at


def test_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op9_lines(spark, sf).collect()
    got = [tuple(r) for r in registry.repeated_runs(spark, sf).collect()]
    want, source, whole, at = slow_runs(docs, rows)
    assert set(got) == want and len(set(got)) == len(got) and len(got) > 20

    gone = {(d, i) for d, a, z, _ in got for i, (x, y) in enumerate(at[d]) if a <= x and y <= z}
    assert not any((d, i) in gone for d in whole for a, z in whole[d] for i in range(a, z))
    for place in gone:  # each word that goes leads to one that stays
        for _ in range(10_000):
            if place not in gone:
                break
            place = source[place[0]][place[1]]
        assert place not in gone


def _planted(seed=4):
    rng = random.Random(seed)
    words = lambda n: [rng.choice(["ab", "Cde", "fg", "hij", "klmn", "öp", "qrs"]) + str(rng.randrange(9999)) for _ in range(n)]
    passage = words(60)
    docs = {d: " ".join(words(rng.randint(20, 60)) + passage + words(rng.randint(20, 60))) for d in range(40)}
    return docs | {d: " ".join(words(150)) for d in range(40, 60)}, passage


def test_a_repeat_of_60_words_goes_whole(spark):
    docs, passage = _planted()
    df = spark.createDataFrame(list(docs.items()), SCHEMA)
    clean = {r.doc_id: r.text for r in lines.remove_runs(df).collect()}
    for d, text in docs.items():
        assert clean[d].split() == (text.replace(" ".join(passage), "") if 0 < d < 40 else text).split()
    assert {r.n_words for r in lines.repeated_runs(df).collect()} == {60}


def test_a_kept_line_is_not_cut(spark):
    rng = random.Random(8)
    words = lambda n: [f"{rng.choice('abcdefg')}{rng.randrange(9999)}" for _ in range(n)]
    passage, ends = words(60), words(4)
    line = " ".join(ends[:2] + passage + ends[2:])
    rows = [(1, " ".join(words(30) + passage + words(30))), (2, f"x y\n{line}\nz"), (3, f"{line}\nw v u"), (4, " ".join(words(30) + passage + words(9)))]
    clean = {r.doc_id: r.text for r in lines.remove_runs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert clean[1] == rows[0][1] and clean[2] == rows[1][1] and clean[3].split() == "w v u".split() and len(clean[4].split()) == 39


def test_edges(spark):
    line = "this line has more than eight words in it, really"
    rows = [(1, None, 1), (2, "", 2), (3, f"{line}\n{line}", 3), (3, f"{line}\n{line}", 3), (None, line, 4), (9, (line + "\n") * 3000, 5)]
    rows += [(10, "w " * 200_000, 6), (11, "\n \n\t", 7), (12, f"{line}\nand one", 8), (12, f"{line}\nand two", 9), (13, "É" * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = [(r.doc_id, r.text, r.start) for r in lines.remove_runs(df).collect() if r.doc_id not in (None, 9, 10, 13)]
    want = [(1, None, 1), (2, "", 2), *[(3, line + "\n", 3)] * 2, (11, "\n \n\t", 7), (12, "\nand one", 8), (12, "\nand two", 9)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    clean = {r.doc_id: r.text for r in lines.remove_runs(df).collect()}
    assert clean[None] == line and clean[9].strip() == "" and clean[13] == rows[-1][1] and clean[3] == line + "\n"
    assert clean[10].split() == ["w"] * (lines.WINDOW + lines.AMONG - 1)
    assert lines.repeated_runs(df.limit(0)).collect() == []


def test_units_that_occur_once_go_no_further(spark):
    docs = lines._tagged(registry.table(spark, "/root/testdata/sf0.001", "documents"), "doc_id", "text")
    found = saved(lines._units_of(docs, lines.KINDS))
    times = Counter(r.h1 for r in found.collect())
    want = Counter(tuple(r) for r in found.collect() if times[r.h1] > 1)
    assert Counter(tuple(r) for r in lines._repeated(found).select(found.columns).collect()) == want
    assert 0 < want.total() < found.count() / 2


def test_runs_end_with_their_text(spark):
    rng = random.Random(6)
    words = lambda n: [f"{rng.choice(['ab', 'Ö', 'é'])}{rng.randrange(9999)}" for _ in range(n)]
    one, two = (" ".join(words(60)) for _ in range(2))
    rows = [(d, [one, f" {two}\n", f"{one} {' '.join(words(30))} {two}"][d % 3]) for d in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    together, apart = ({tuple(r) for r in lines.repeated_runs(df.repartition(n)).drop("tag").collect()} for n in (1, 30))
    assert together == apart
    for d, text in rows[3:]:
        gone = sorted((a, z) for i, a, z, _ in together if i == d)
        assert [text[a:z] for a, z in gone] == [[one], [two], [one, two]][d % 3]
    assert {i for i, *_ in together if i < 3} == {2}
