import zlib

import numpy as np
import pytest

from relinker.llm import langid, registry

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.op3_language(spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_prediction_uses_text_only(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    other = df.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 'xx' ELSE lang END AS lang")
    assert sorted(langid.language_id(df).collect()) == sorted(langid.language_id(other).collect())


def test_two_steps():
    rng = np.random.default_rng(0)
    text = {lang: ["".join(rng.choice(list(letters), 200)) for _ in range(40)] for lang, letters in
            {"en": "thesand  ", "de": "scheund  ", "fr": "quelai  é", "ru": "ябвгде  "}.items()}
    x = np.array([langid.features(t) for some in text.values() for t in some])
    langs = np.array([lang for lang in text for _ in range(40)], dtype=object)
    model = langid.Identifier.train(x, langs)
    assert model.family.names == ["germanic", "romance", "slavic"] and model.within["germanic"].names == ["de", "en"]
    for lang, letters in (("en", "thesand  "), ("de", "scheund  "), ("ru", "ябвгде  ")):
        got, p = model.predict("".join(rng.choice(list(letters), 300)))
        assert got == lang and 0.5 < p <= 1


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ... !!", "de"), (None, "the and of", "en"), (4, "the and of", None)]
    rows += [(i, "the and of that " * 5, "en") for i in range(10, 40)] + [(i, "der und die das " * 5, "de") for i in range(40, 70)]
    rows += [(99, "der und die das " * 60_000, "de")] * 2
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = langid.language_id(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 3))
    assert by[None].lang_pred == by[4].lang_pred == "en" and by[99].lang_pred == "de" and by[None].held_out is False
    assert langid.language_id(df.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.language_id(df.filter("doc_id = 4")).collect()} == {"und"}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rows = [(i, f"some words {i}", f"l{i % 4}") for i in range(40)]
    with pytest.raises(ValueError, match="over 3 languages"):
        langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
