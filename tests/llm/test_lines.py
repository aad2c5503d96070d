import random
import re

import pytest

from relinker.llm import lines, registry

SF = "/root/testdata/sf0.01"
WHITE = " \t-\r"


def normal(text):
    return " ".join(re.findall(f"[^{WHITE}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))


def slow_units(text, kind):
    """Whole lines, or runs of lines with words (two at least)."""
    at, out, run = 0, [], []
    for line in [*text.split("\n"), ""]:
        if normal(line):
            run.append((at, at + len(line)))
            if kind == "line":
                out.append((at, at + len(line), normal(line)))
        else:
            if kind == "paragraph" and len(run) > 1:
                out.append((run[0][0], run[-1][1], normal(text[run[0][0] : run[-1][1]])))
            run = []
        at += len(line) + 1
    return out


def slow(docs, kind):
    first, out = {}, set()
    for doc, text in sorted(docs):
        for a, b, words in slow_units(text or "", kind):
            kept = first.setdefault(words, (doc, a))
            if kept != (doc, a):
                out.add((doc, kind, a, b, *kept))
    return out


def test_whole_table(spark):
    docs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = [tuple(r) for r in registry.op9_lines(spark, SF).collect()]
    for kind in ("line", "paragraph"):
        found = [r for r in rows if r[1] == kind]
        assert set(found) == slow(docs.items(), kind) and len(set(found)) == len(found)
    assert any(r[1] == "line" for r in rows)
    passages = [r for r in rows if r[1] == "passage"]
    for doc, _, a, b, kept, at in passages:
        words = normal(docs[doc][a:b])
        assert len(words.split()) == lines.WINDOW and normal(docs[kept][at:]).startswith(words) and (kept, at) < (doc, a)

    # any repeat of a long run of words is met by a passage
    size, seen, missed, met = lines.WINDOW + lines.AMONG - 1, {}, 0, 0
    spans = {d: [(a, b) for x, _, a, b, _, _ in passages if x == d] for d in docs}
    for doc in sorted(docs):
        words = [m.span() for m in re.finditer(f"[^{WHITE}]+", docs[doc] or "")]
        low = normal(docs[doc] or "").split()
        for i in range(len(low) - size + 1):
            run = " ".join(low[i : i + size])
            if seen.setdefault(run, (doc, i)) != (doc, i):
                inside = [a for a, b in spans[doc] if words[i][0] <= a and b <= words[i + size - 1][1]]
                met, missed = met + bool(inside), missed + (not inside)
    assert met > 1000 and missed == 0


def test_lines_against_sql(spark, same_as_sql):
    same_as_sql(registry.repeated_lines(spark, SF), registry.ORACLE["repeated_lines"], SF)


@pytest.mark.parametrize("kind", ["line", "paragraph"])
def test_units(spark, kind):
    docs = [
        (1, "One two three.\n\nSix seven\nten. Short one.\n\nAll rights reserved.\n\n\x0b"),
        (2, "ONE  two\tthree.\r\n \nOther words are here.\n\n six  Seven\nten. Short one. "),
        (3, "All rights reserved.\nÉ É\né É\nSix seven\nten. Short one."),
        (4, "x\nall rights  reserved.\nÉ É"),
    ]
    got = lines.repeated_units(spark.createDataFrame(docs, "doc_id long, text string"), kinds=(kind,)).drop("tag")
    assert {tuple(r) for r in got.collect()} == slow(docs, kind)


def test_whole_lines_in_any_company(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    line = " ".join(word() for _ in range(40))
    rows = [(d, f"{word()} {word()}\n{line}\n{word()} {word()} {word()}") for d in range(300)]
    got = lines.repeated_units(spark.createDataFrame(rows, "doc_id long, text string"), kinds=("line",)).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(d, 0) for d in range(1, 300)}
    assert all(rows[r.doc_id][1][r.start : r.end] == line for r in got)


def test_passages_in_the_middle_of_lines(spark):
    rng = random.Random(4)
    words = lambda n: [rng.choice(["ab", "cde", "fg", "hij", "klmn", "op", "qrs"]) + str(rng.randrange(999)) for _ in range(n)]
    passage = words(70)
    docs = [(d, " ".join(words(rng.randint(20, 60)) + passage + words(rng.randint(20, 60)))) for d in range(30)]
    docs += [(d, " ".join(words(150))) for d in range(30, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in lines.repeated_units(df).collect()} == set(range(1, 30))
    for r in lines.remove_units(df).collect():
        if 1 <= r.doc_id < 30:
            assert sum(w in passage for w in r.text.split()) < 50 and set(r.text.split()) >= set(docs[r.doc_id][1].split()) - set(passage)
        else:
            assert r.text == docs[r.doc_id][1]


def test_texts_under_one_id(spark):
    shared = "a line that both of the texts hold"
    rows = [(1, f"{shared}\nand one"), (2, f"{shared}\nand two"), (2, f"quite another text\n{shared}"), (2, "nothing that could ever be cut")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.text for r in lines.remove_units(df).collect())
    assert got == sorted([rows[0][1], "\nand two", "quite another text\n", rows[3][1]])
    same = spark.createDataFrame([(7, f"{shared}\nx y"), (7, f"{shared}\nz")], "doc_id long, text string")
    assert len(lines.repeated_units(same).collect()) == 1


def test_edges(spark):
    long = "this line has more than eight words in it, really"
    rows = [(1, None, 1), (2, "", 2), (3, f"{long}\n{long}", 3), (3, f"{long}\n{long}", 3), (None, long, 4), (9, (long + "\n") * 3000, 5)]
    rows += [(10, "w " * 400_000, 6), (11, "\n \n\t", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = [r for r in lines.repeated_units(df, kinds=("line",)).collect()]
    assert {(r.doc_id, r.start) for r in got} == {(3, len(long) + 1)} | {(9, i * (len(long) + 1)) for i in range(3000)}
    assert all((r.kept_doc_id, r.kept_start) == (3, 0) for r in got)
    clean = {r.doc_id: r for r in lines.remove_units(df, kinds=("line",)).collect()}
    assert clean[1].text is None and clean[3].text == long + "\n" and clean[None].text == long and clean[9].text.strip() == ""
    assert {r.doc_id for r in lines.repeated_units(df).collect()} == {3, 9, 10}
    assert lines.remove_units(df).filter("doc_id = 10").collect()[0].text.count("w") == lines.AMONG
    assert lines.repeated_units(df.limit(0)).collect() == []
