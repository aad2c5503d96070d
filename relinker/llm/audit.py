"""Source divergence audit: what each source of a language says otherwise than the rest.

Terms are counted where the texts are, in Arrow (``ascii_lower``, ``split_pattern_regex``,
``dictionary_encode`` and a hash ``group_by`` inside ``mapInArrow``); tasks send partial
counts. Sources are then held against each other in columnar shards of the vocabulary,
whose sums are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relinker.llm.common import parts, saved, scratch, ship

#: What stands between terms: all of ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are split at once (a longer text alone), and rows of counts that a task holds before it sends them.
_LOT, _HELD = 8 << 20, 400_000
#: Terms of a shard and sources of a block: a shard's matrix has twice BLOCK rows at most.
SHARD, BLOCK = 20_000, 64
_KEYS = ["lang", "source", "term"]
_COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(batch: pa.RecordBatch | pa.Table) -> pa.Table:
    """``lang, source, term, n, docs`` of rows ``lang, source, text`` (no nulls); an empty term stands for a group's being there."""
    groups = pa.table({"lang": batch["lang"], "source": batch["source"]})
    there = groups.group_by(["lang", "source"]).aggregate([])
    empty = pa.array(np.zeros(len(there), np.int64))
    marks = there.append_column("term", pa.array([""] * len(there))).append_column("n", empty).append_column("docs", empty)
    text = batch["text"].combine_chunks() if isinstance(batch["text"], pa.ChunkedArray) else batch["text"]
    found = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    terms, row = pc.list_flatten(found), pc.list_parent_indices(found)
    some = pc.not_equal(terms, "")
    coded = pc.dictionary_encode(terms.filter(some))
    if not len(coded):
        return marks
    each = pa.table({"row": row.filter(some), "code": coded.indices})
    in_docs = each.group_by(["row", "code"]).aggregate([([], "count_all")])
    of_doc = groups.take(in_docs["row"]).append_column("code", in_docs["code"]).append_column("n", in_docs["count_all"])
    sums = of_doc.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ("n", "count")])
    words = pc.take(coded.dictionary, sums["code"].combine_chunks())
    counts = pa.table({"lang": sums["lang"], "source": sums["source"], "term": words, "n": sums["n_sum"], "docs": sums["n_count"]})
    return pa.concat_tables([marks, counts])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in lots of ``_LOT`` bytes of text."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(batch):
        before = int(ends[a - 1]) if a else 0
        z = max(a + 1, int(np.searchsorted(ends, before + _LOT, side="right")))
        yield batch.slice(a, z - a)
        a = z


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0

    def merged() -> pa.Table:
        sums = pa.concat_tables(held).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")])
        return sums.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])

    for batch in batches:
        for some in _slices(batch):
            held.append(term_counts(some))
            rows += len(held[-1])
            if rows > _HELD:
                held = [merged()]
                rows = len(held[0])
                if rows > _HELD // 2:  # too many different terms: others add them up
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
    if held:
        yield from merged().to_batches(max_chunksize=50_000)


def count_terms(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and rows that have the term; an empty term with 0 for each group.

    Nulls read as empty. A row is a document, whatever its id.
    """
    ship(df.sparkSession)
    name = lambda c, to: F.coalesce(F.col(c), F.lit("")).alias(to)
    rows = df.select(name(lang_col, "lang"), name(source_col, "source"), name(text_col, "text"))
    sums = rows.mapInArrow(_partial, _COUNTS).groupBy(*_KEYS)
    return sums.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exactly, whatever the size."""
    wide = lambda c: f"CAST({c} AS DECIMAL(20, 0))"
    up, down = f"(CAST(1000000000 AS DECIMAL(10, 0)) * ({wide(count)} + 5))", f"({wide(total)} + 5 * {wide(terms)})"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + {up} div {down} ELSE 0 END")


def _shard_sums(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums of differences between the sources of a shard, over the terms that one of them has."""
    source = rows["source"].combine_chunks().dictionary_encode()
    codes, names = source.indices.to_numpy(), source.dictionary
    share, block = rows["p"].to_numpy(), rows["block"].to_numpy()
    mark = pc.equal(rows["term"], "").to_numpy()
    none, blocks = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    none[codes[mark]], blocks[codes[mark]] = share[mark], block[mark]
    terms = rows["term"].filter(pa.array(~mark)).combine_chunks().dictionary_encode()
    table = np.repeat(none[:, None], len(terms.dictionary), axis=1)
    table[codes[~mark], terms.indices.to_numpy()] = share[~mark]
    apart = key[2].as_py() != key[3].as_py()
    a, b, sums = [], [], []
    for i in range(len(names)):
        others = np.flatnonzero(blocks != blocks[i]) if apart else np.flatnonzero(np.arange(len(names)) != i)
        a.append(np.full(len(others), i))
        b.append(others)
        sums.append(np.abs(table[others] - table[i]).sum(axis=1))
    a, b, sums = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (a, b, sums))
    lang = pa.array([key[0].as_py()] * len(a), pa.string())
    met = pa.array(np.full(len(a), table.shape[1], np.int64))
    return pa.table({"lang": lang, "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": sums, "met": met})


def divergences(
    df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *, least: int = 30, top: int = 50
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each source that a language has.

    Terms are runs of letters (all beyond ASCII are letters), A-Z lower-cased; a language
    keeps those of ``least`` of its rows. A term's share in a source, and in the
    language, is 1 + floor(10^9 (count + 5) / (N + 5 V)), N and V the sum and number of
    kept terms. Part ``pair``: each other source of the language with the sum of differences
    of shares, largest first. Part ``term``: the ``top`` terms of the source whose share
    exceeds the language's by most. Ties rank by item (UTF-8). Nulls read as empty, so
    the empty language and source are ones of their own; sources without terms have
    the share of a count of 0; a language without kept terms gives pairs of value 0; an empty
    table gives no rows. Other columns are not read. Repeated rows count each.
    """
    spark = df.sparkSession
    with scratch(spark) as keep:
        counts = saved(count_terms(df, lang_col, source_col, text_col))
        terms = counts.filter("term <> ''")
        vocab = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"))
        vocab = saved(vocab.filter(F.col("docs") >= least).select("lang", "term", "all_n"))
        kept = saved(terms.drop("docs").join(vocab, ["lang", "term"]))
        of_lang = vocab.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
        order = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        groups = counts.filter("term = ''").select("lang", "source", F.floor(order / BLOCK).cast("int").alias("block"))
        groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        groups = groups.join(of_lang, "lang", "left").na.fill(0, ["total", "v", "lang_n"])
        blocks = F.max("block").over(Window.partitionBy("lang")).alias("blocks")
        groups = saved(groups.select("*", blocks, F.lit(0).alias("zero")).withColumn("p0", _share("zero", "total", "v")).drop("zero"))

        shares = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "v"))
        more = shares.withColumn("value", F.col("p") - _share("all_n", "lang_n", "v")).filter("n > 0 AND value > 0")
        rank = lambda item: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), item))
        more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank("term").alias("rank"))
        more = more.filter(F.col("rank") <= top)

        many = max(1, -(-(groups.agg(F.max("v")).first()[0] or 0) // SHARD), min(8, parts(spark)))
        of_terms = shares.select("lang", F.pmod(F.xxhash64("term"), F.lit(many)).cast("int").alias("shard"), "block", "blocks", "source", "term", "p")
        of_groups = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("shard"), "block", "blocks", "source", F.lit("").alias("term"), F.col("p0").alias("p"))
        rows = of_terms.union(of_groups).withColumn("other", F.explode(F.sequence(F.lit(0), "blocks")))
        rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
        sums = rows.groupBy("lang", "shard", "low", "high").applyInArrow(_shard_sums, "lang string, source string, item string, value long, met long")
        sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("met_value"), F.sum("met").alias("met"))
        end = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
        pairs = sums.join(groups.select("lang", "source", "v", "p0"), ["lang", "source"]).join(end, ["lang", "item"])
        value = (F.col("met_value") + (F.col("v") - F.col("met")) * F.abs(F.col("p0") - F.col("q0"))).alias("value")
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value)
        return keep(pairs.withColumn("rank", rank("item")).union(more))
