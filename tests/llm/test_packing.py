import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from relinker.llm import common, packing, registry

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for got in bins.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_rank_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(rng.integers(1, 50)) for n in rng.choice(np.arange(1, 101), rng.integers(1, 90), replace=False)}
    rows, bins = packing.plan_bins(counts, 100)
    used = np.zeros(bins, int)
    spans = {}
    for n, first, each, bin0, offset, total in rows.tolist():
        for i in range(total):
            spans.setdefault(bin0 + i // each, []).append((offset + i % each * n, n))
        assert first == sum(t for m, f, _, _, _, t in rows.tolist() if m == n and f < first)
        used[bin0 : bin0 + -(-total // each)] += 1
    assert sum(rows[:, 5]) == sum(counts.values())
    for got in spans.values():
        at = 0
        for offset, n in sorted(got):
            assert offset == at
            at += n
        assert at <= 100
    total = sum(n * c for n, c in counts.items())
    assert -(-total // 100) <= bins


def test_odd_texts_as_the_tokenizer_says():
    tok = Tokenizer.from_file(PATH)
    texts = ["", " \n\t", "Don't STOP, it's 42!!", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul été", "a b c\x1cd", "<|endoftext|> x", "日本語 text", "ﬁ ǅ 😀😀 a‍b", "x" * 3000]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert packing.WordTokens(PATH).encode(texts) == want
    assert packing.WordTokens(PATH).encode(texts[::-1] * 2) == want[::-1] * 2


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.op1_packing(spark, sf).collect()
    tok = Tokenizer.from_file(PATH)
    want = {}
    for doc, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k in range(0, len(ids), 2048):
            want[doc, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins, total = check_bins(rows, 2048), sum(r.length for r in rows)
    assert bins <= 1.02 * -(-total // 2048)


def test_edges(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "hello", "c"), (2, "word " * 5000, None), (2, "word " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == sorted(
        [(1, 0, 1), (1, 0, 1), (0, 0, 2)] + [(2, 0, 2048), (2, 1, 2048), (2, 2, 905)] * 2
    )
    check_bins(got, 2048)
    assert packing.pack_documents(df.limit(0), PATH).collect() == []


def test_characters_newer_than_the_tokenizer(spark):
    """Every code point between words and inside one: as the tokenizer has it."""
    import unicodedata

    import numpy as np
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = [c for c in codes if unicodedata.category(chr(c)) == "Cn"]
    some = [*odd[:: len(odd) // 3000], *codes[::149], 0x88F, 0x208F, 0x209D]
    texts = [f"ab{chr(c)}cd {chr(c)} e{chr(c)}" for c in some]
    got = packing.WordTokens.of(path).encode(texts)
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_one_id_and_length_for_all(spark):
    """Rows that share a null id, a piece and a length are dealt to all salts."""
    pieces = spark.createDataFrame([(None, 0, 700)] * 500, "doc_id long, piece int, length long")
    rows = packing.best_fit_pack(pieces, 2048, salts=8).collect()
    check_bins(rows, 2048)
    assert len({r.sequence_id for r in rows}) == 250


def test_words_are_looked_up_by_the_lot(spark, monkeypatch):
    """Ids as by the tokenizer through turns of the table, and known words cost no Python step each."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "_CACHE", 50)
    tokenizer, words = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    texts = [f"w{i}x Same {'long' * (i % 7)}end\u00a0{i * 7919} \x00 caf\u00e9\u3000" if i % 3 else f"Plain {i} text, {'a' * (i % 40)}" for i in range(300)]
    texts += ["", " ", "a\0", "a", "abcdefghijklmnop", "abcdefghijklmnopq", "\u2003"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        got = [g for i in range(0, len(texts), 40) for g in words.encode(texts[i : i + 40])]
        assert [[int.from_bytes(g[k : k + 4], "little") for k in range(0, len(g), 4)] for g in got] == want
    asked, real = [], packing.WordTokens._ids
    monkeypatch.setattr(packing, "_CACHE", 10_000)
    monkeypatch.setattr(packing.WordTokens, "_ids", lambda self, w: asked.extend(w) or real(self, w))
    some = ["the same words again and again"] * 50
    words.encode(some), asked.clear(), words.encode(some)
    assert asked == []


def test_words_without_a_key_leave_the_pool():
    tokens = packing.WordTokens(PATH)
    texts = [" ".join(f"interoperability{i}of{k}" for i in range(200)) for k in range(3)]
    first = tokens.encode(texts)
    held = len(tokens.pool)
    assert held < sum(map(len, first)) // 8
    for _ in range(5):
        assert tokens.encode(texts) == first
    assert len(tokens.pool) == held


def test_worker_gets_texts_by_bytes(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    monkeypatch.setattr(packing, "saved", lambda df: seen.append(spark.conf.get(name, None)) or common.saved(df))
    docs = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 40000) AS text")
    assert packing.pack_documents(docs, PATH).agg({"length": "sum"}).first()[0] == 60 * 40_001
    assert seen[0] == str(common.BATCH) and spark.conf.get(name, None) is None

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    many = lambda: docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
    with common.arrow_batches(spark):
        assert many() < 25
    assert many() == 60
    spark.conf.set(name, "300000")
    try:
        with common.arrow_batches(spark):
            assert many() < 4 and spark.conf.get(name) == "300000"
    finally:
        spark.conf.unset(name)
