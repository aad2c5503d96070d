"""URL filter: host and path rules, and naive Bayes over segmented names for the rest.

A unigram Viterbi splits concatenated names into words; the unigrams are counted in
Spark over the text of all pages. Each distinct name meets only the words that are
its own substrings, by a join, so no word list is broadcast.
"""

from __future__ import annotations

import re
from functools import reduce
from math import log, log10

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relinker.llm.common import saved, ship

#: Fixed values: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a key under which names meet words; longer words meet by their first letters.
KEY = 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_rule(host: Column, path: Column, rules) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits; null without one."""
    by_length = sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True)
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in by_length]
    made = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in by_length]
    return reduce(lambda c, x: c.when(*x), zip(fits[1:], made[1:]), F.when(fits[0], made[0]))


def viterbi(name: str, words: dict[str, int], total: int) -> list[str]:
    """Most likely split of ``name``; a part that is no known word costs ten-fold for each letter."""
    longest = max(map(len, words), default=0)
    rare = 1 - log10(total)
    best: list[tuple[float, int]] = [(0.0, 0)]
    strange = (-float("inf"), 0)  # the best split that ends within a part that is no word
    for end in range(1, len(name) + 1):
        strange = max((strange[0] - 1, strange[1]), (best[end - 1][0] + rare - 1, end - 1))
        options = [strange]
        for start in range(max(0, end - longest), end):
            if (n := words.get(name[start:end])) is not None:
                options.append((best[start][0] + log10(n / total), start))
        best.append(max(options))
    out, end = [], len(name)
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """``word, n``: whole words of at least 2 letters, all a-z, in all rows of a text column, mark-up dropped."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "<[^>]*>", " "))
    words = F.regexp_extract_all(plain, F.lit(r"(?<![\p{L}\p{M}])[a-z]{2,}(?![\p{L}\p{M}])"), F.lit(0))
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name, words`` for each distinct name of ``names(name)`` (letters a-z)."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    starts = F.sequence(F.lit(1), F.length("name"))
    subs = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(KEY), F.length("name") - i + 1)), lambda n: F.substr(F.col("name"), i, n)
            ),
        )
    )
    names = names.filter("name <> ''").distinct()
    keyed = counts.withColumn("key", F.substring("word", 1, KEY))
    met = names.select("name", F.explode(F.array_distinct(subs)).alias("key")).join(keyed, "key")
    met = met.filter((F.length("word") <= KEY) | F.contains("name", "word"))
    known = met.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([viterbi(n, dict(k or {}), total) for n, k in zip(name, known)])

    return names.join(known, "name", "left").select("name", split("name", "known").alias("words"))


def _names(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("[a-z]+"), F.lit(0))


def _rule_names(rules) -> list[str]:
    """Names that the rules themselves speak of: host labels and path segments."""
    return sorted({n for host, path, _ in rules for n in re.findall("[a-z]+", f"{host} {path}".lower())})


def ruled(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Id, host, path, rule and the rule's verdict (both null without one) for each row of ``df``: one narrow projection."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    hit = _longest_rule(F.col("host"), F.col("path"), rules).alias("hit")
    return rows.select("*", hit).select(id_col, "host", "path", "hit.rule", "hit.verdict")


def filter_urls(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", rules=RULES,
    learn: Column | None = None, split: bool = True,
) -> DataFrame:
    """One row for each row of ``df``: id, host, path, rule (or null), verdict, score (log odds of block).

    The rules decide the URLs that they fit and label them for training, where ``learn``
    is true (by default everywhere); the model decides the others. Tokens are the words
    into which the names of host and path are split (with ``split`` false the names
    themselves, for comparison), but for the host's last label and the names that the rules speak
    of, which would only say again what the rules say. Every URL of a labelled host and path counts
    once a row. A null URL, or one without ``://``, has an empty host and path and, like
    one whose words no labelled URL has, gets the prior's verdict: block only where blocked
    training rows are more. Repeated rows and null ids stay rows of their own; other
    columns are not carried; an empty table gives no rows.
    """
    ship(df.sparkSession)
    url = F.col(url_col)
    taught = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    rows = df.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), taught.alias("taught"))
    rows = rows.withColumn("hit", _longest_rule(F.col("host"), F.col("path"), rules))
    urls = rows.groupBy("host", "path").agg(F.first("hit").alias("hit"), F.count_if("taught").alias("many"))
    urls = saved(urls.withColumn("label", F.when(F.col("many") > 0, F.col("hit.verdict"))))
    host = F.regexp_replace("host", r"\.[^.]*\z", "")
    named = urls.select("host", "path", F.explode(F.concat(_names(host), _names(F.col("path")))).alias("name"))
    named = named.filter(~F.col("name").isin(_rule_names(rules)))
    if split:
        cut = saved(segment(named.select("name"), saved(word_counts(df, text_col))))
        words = named.join(cut, "name").select("host", "path", F.explode("words").alias("token"))
    else:
        words = named.withColumnRenamed("name", "token")
    per_url = saved(words.groupBy("host", "path", "token").agg(F.count("*").alias("n")))
    labelled = urls.filter("label IS NOT NULL").select("host", "path", "many", "label")
    block = lambda c: F.sum(F.when(F.col("label") == "block", F.col(c)).otherwise(0))
    allow = lambda c: F.sum(F.when(F.col("label") == "allow", F.col(c)).otherwise(0))
    seen = per_url.join(labelled, ["host", "path"]).withColumn("w", F.col("n") * F.col("many"))
    token_counts = saved(seen.groupBy("token").agg(block("w").alias("b"), allow("w").alias("a")))
    sums = token_counts.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    rows_of = labelled.agg(block("many"), allow("many")).first()
    n_b, n_a, size = (x or 0 for x in sums)
    prior = log(((rows_of[0] or 0) + 1) / ((rows_of[1] or 0) + 1))
    odds = F.log((F.col("b") + 1) / F.lit(float(n_b + size + 1))) - F.log((F.col("a") + 1) / F.lit(float(n_a + size + 1)))
    scored = per_url.join(token_counts.select("token", odds.alias("odds")), "token", "left")
    sums_of = scored.groupBy("host", "path").agg(F.sum(F.col("n") * F.coalesce("odds", F.lit(0.0))).alias("sum"))
    out = rows.join(sums_of, ["host", "path"], "left")
    score = F.lit(prior) + F.coalesce("sum", F.lit(0.0))
    return out.select(
        id_col, "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"),
    )


__all__ = ["RULES", "filter_urls", "host_of", "path_of", "ruled", "segment", "viterbi", "word_counts"]
