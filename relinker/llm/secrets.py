"""Secret scan with DataFrame functions only: base patterns, and character Markov models.

Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples, a user's or those of
``labelled_samples`` (drawn strings, and what in the corpus cannot be a secret); a run of token characters, or a part of it, is a secret
where the mean log-likelihood ratio per transition exceeds a threshold.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relinker.llm.common import documents, saved

#: Pattern, the group whose length counts, and its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: A text in which this is not found has no span of the kind (same runs, cheaper to look for).
_GUARD = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"' :=]", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
#: Fixed value: the characters of a token.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_RUN = "[A-Za-z0-9+/_=-]"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
_PART = "array<struct<start:int,end:int>>"
MARKOV = len(BASE)
#: How far the running sum falls from its peak before a stretch of a run is closed.
DROP = 8.0
#: Common identifiers that every corpus is taken to have.
ORDINARY = """
get_user_name setDefaultValue MAX_BUFFER_SIZE user_id_1 file-name-2 error_code_404 session_timeout_seconds createdAt updatedAt
/usr/local/lib/python3 /var/log/system/messages /home/user/documents/report-2024-01-15 /api/v1/users/1024/orders
src/main/java/com/example/App content-type=text/html charset=utf-8 accept-language=en-US 2024-01-15 2023-12-31T23-59-59
1999-07-04 20240115 10000 555-0123-4567 page=2 id=12345 key=value name=value width=100 height=200 internationalization
configuration_of_services DatabaseConnectionFactory isEmptyString x-forwarded-for /download/archive/index
/images/logo_small_200x100 application/json text/plain last-modified-date state-of-the-art README LICENSE_FILE
test_case_number_12 TableOfContents customer-service-department HTTP_REQUEST_HEADER XMLHttpRequest utf8_general_ci en_US
"""
SHARE = 0.15


def _spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """All leftmost non-overlapping matches whose group is long enough, in code points.

    ``split`` gives the text between the matches, so running sums of the lengths of
    both give the positions.
    """
    rx = F.lit(pattern)
    rows = F.arrays_zip(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, rx, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, rx, F.lit(group)).alias("value"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPAN).alias("out"))

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.length(row["between"])
        end = start + F.coalesce(F.length(row["whole"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), row["value"].alias("value"))
        found = F.coalesce(acc["out"], F.array().cast(_SPAN))
        keep = F.length(row["value"]) >= least
        return F.struct(end.alias("at"), F.when(keep, F.concat(found, F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.coalesce(F.aggregate(rows, zero, step, lambda a: a["out"]), F.array().cast(_SPAN))


def _scan(docs: DataFrame, min_length: int) -> DataFrame:
    """doc_id, base spans, and runs of at least ``min_length`` token characters."""
    return _scan_with_text(docs, min_length).drop("text")


def _scan_with_text(docs: DataFrame, min_length: int) -> DataFrame:
    text, none = F.col("text"), F.array().cast(_SPAN)
    base = [
        F.when(text.rlike(_GUARD[k]), _spans(text, rx, group, least, i)).otherwise(none)
        for i, (k, (rx, group, least)) in enumerate(BASE.items())
    ]
    long_run = f"{_RUN}{{{min_length},}}"
    runs = F.when(text.rlike(long_run), _spans(text, long_run, 0, min_length, MARKOV)).otherwise(none)
    return docs.withColumns({"base": F.concat(*base), "runs": runs})


def corpus_samples(docs: DataFrame) -> DataFrame:
    """Samples ``value, label`` of ordinary identifiers (label 0) in all of ``docs(text)``, which no secret can be among.

    Words are whole tokens of 3 to 11 letters that two documents have: shorter than any
    secret. A sample is a token whose letters are such words, apart from signs, digits
    (8 in a row at most) and changes of case. Each distinct one counts once, so what
    one source repeats weighs no more, and keys without words never count.
    """
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(f"{_RUN}{{3,}}"), F.lit(0)))
    counted = saved(docs.select(F.explode(tokens).alias("value")).filter(F.length("value") <= 256).groupBy("value").count())
    words = counted.filter((F.col("count") >= 2) & F.col("value").rlike(r"\A[A-Za-z]{3,11}\z"))
    words = words.select(F.lower("value").alias("word")).distinct()
    cut = F.regexp_replace("value", r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "-")
    letters = F.array_distinct(F.regexp_extract_all(F.lower("cut"), F.lit("[a-z]+"), F.lit(0)))
    found = counted.filter(~F.col("value").rlike("[0-9]{9}")).select("value", cut.alias("cut")).select("value", letters.alias("letters"))
    found = found.filter(F.forall("letters", lambda w: F.length(w).between(3, 11)))
    numbers = found.filter((F.size("letters") == 0) & (F.length("value") < 12)).select("value")
    named = found.select("value", F.size("letters").alias("size"), F.explode("letters").alias("word")).join(words, "word")
    named = named.groupBy("value", "size").count().filter("count = size").select("value")
    return named.union(numbers).select("value", F.lit(0).alias("label"))


def random_samples(spark: SparkSession, many: int = 20_000, length: int = 32) -> DataFrame:
    """Samples ``value, label`` of random strings (label 1), made by hashing: a sign has a tenth of a letter's or digit's share."""
    drawn = "".join(c * 10 if c.isalnum() else c for c in ALPHABET)
    at = lambda i: F.pmod(F.xxhash64(F.col("id"), i), F.lit(len(drawn))).cast("int") + 1
    letters = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substr(F.lit(drawn), at(i), F.lit(1)))
    return spark.range(many).select(F.array_join(letters, "").alias("value"), F.lit(1).alias("label"))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """``value, label`` to train on, where a corpus ``docs(text)`` has no labels of its own: identifiers 0, random strings 1."""
    return corpus_samples(docs).union(random_samples(docs.sparkSession))


def _counts(samples: DataFrame) -> list[list[list[float]]]:
    """How many of each transition the samples of each label have."""
    n = F.length("value")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(F.col("value"), i, F.lit(2)))
    counted = (
        samples.filter((n >= 2) & F.col("label").isin(0, 1))
        .select("label", F.explode(pairs).alias("pair"))
        .filter(F.col("pair").rlike(rf"\A{_RUN}{{2}}\z"))
        .groupBy("label", "pair")
        .count()
        .collect()
    )
    size = len(ALPHABET)
    counts = [[[0.0] * size for _ in range(size)] for _ in range(2)]
    for label, pair, many in counted:
        counts[label][ALPHABET.index(pair[0])][ALPHABET.index(pair[1])] += many
    return counts


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition, from ``samples(value, label)``.

    Counted in Spark over all samples; only the two tables of transitions, bounded by
    the alphabet squared, come to the driver. Without samples of a label its model is
    uniform. Null values, null labels and characters outside the alphabet count nothing.
    """
    logs = [[[log(p) for p in row] for row in _transitions(c)] for c in _counts(samples)]
    return [b - a for rows in zip(*logs) for a, b in zip(*rows)]


def train_on_corpus(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition, from ``labelled_samples(docs)``.

    To the identifiers come those of ``ORDINARY``, whose characters have a share
    of ``SHARE`` in each row, as the corpus may lack a language or kind of identifier.
    """
    (plain, drawn), size = _counts(labelled_samples(docs)), len(ALPHABET)
    often = [1.0] * size
    for name in ORDINARY.split():
        places = [ALPHABET.index(c) for c in name]
        for a, b in zip(places, places[1:]):
            plain[a][b] += 1
        for a in places:
            often[a] += 1
    floor = [x / sum(often) for x in often]
    both = zip(_transitions(plain), _transitions(drawn))
    return [log(e / ((1 - SHARE) * p + SHARE * f)) for row, even in both for p, f, e in zip(row, floor, even)]


def _transitions(counts: list[list[float]], weight: float = 10.0) -> list[list[float]]:
    """Transition probabilities; ``weight`` counts of each row follow the overall frequencies of the characters."""
    size, total = len(counts), sum(map(sum, counts))
    overall = [(sum(row[b] for row in counts) + 1) / (total + size) for b in range(size)]
    return [[(n + weight * overall[b]) / (sum(row) + weight) for b, n in enumerate(row)] for row in counts]


def _place(char: Column) -> Column:
    """1-based place of a character in the alphabet."""
    return F.call_function("locate", char, F.lit(ALPHABET))


def _steps(value: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of each transition of a string of token characters."""
    scores, n, size = F.lit(table), F.length(value), len(ALPHABET)
    places = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), _place)
    cell = lambda a, b: F.element_at(scores, (a - 1) * size + b)
    return F.zip_with(F.slice(places, 1, n - 1), F.slice(places, 2, n - 1), cell)


def _mean(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / F.size(steps)


def _peaks(steps: Column, threshold: float) -> Column:
    """Stretches whose ratios exceed ``threshold`` by the largest sums, as offsets in the string.

    A stretch begins where the running sum leaves zero and ends at the sum's peak; it
    is closed when the sum is back at zero or ``DROP`` under the peak, and the next begins.
    """
    none = F.array().cast(_PART)
    zero = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"),
        F.lit(0).alias("end"), none.alias("out"),
    )

    def closed(acc: Column, start: Column, end: Column, peak: Column) -> Column:
        part = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.when(peak > 0, F.concat(acc["out"], part)).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        start = F.when(acc["sum"] > 0, acc["start"]).otherwise(acc["at"])
        total = acc["sum"] + x - threshold
        peak = F.greatest(total, acc["peak"])
        end = F.when(total > acc["peak"], acc["at"] + 2).otherwise(acc["end"])
        over = (total <= 0) | (total < peak - DROP)
        return F.struct(
            (acc["at"] + 1).alias("at"), start.alias("start"), F.when(over, 0.0).otherwise(total).alias("sum"),
            F.when(over, 0.0).otherwise(peak).alias("peak"), end.alias("end"),
            F.when(over, closed(acc, start, end, peak)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(steps, zero, step, lambda a: closed(a, a["start"], a["end"], a["peak"]))


def _merged(parts: Column) -> Column:
    """Parts in order, those that overlap as one."""

    def step(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], p["end"]).alias("end"))
        more = F.when(p["start"] < last["end"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined)))
        return F.when(F.size(out) == 0, F.array(p)).otherwise(F.coalesce(more, F.concat(out, F.array(p))))

    return F.aggregate(F.array_sort(parts), F.array().cast(_PART), step)


def _parts(value: Column, steps: Column, min_length: int, threshold: float) -> Column:
    """Parts of a run that are secrets: pieces between signs, and ``_peaks`` without signs at the ends."""

    def bare(p: Column) -> Column:
        part = F.substr(value, p["start"] + 1, p["end"] - p["start"])
        lead = F.length(part) - F.length(F.regexp_replace(part, r"\A[+/_=-]+", ""))
        tail = F.length(part) - F.length(F.regexp_replace(part, r"[+/_=-]+\z", ""))
        return F.struct((p["start"] + lead).alias("start"), (p["end"] - tail).alias("end"))

    pieces = _spans(value, f"[A-Za-z0-9]{{{min_length},}}", 0, min_length, MARKOV)
    pieces = F.filter(pieces, lambda p: _mean(F.slice(steps, p["start"] + 1, p["end"] - p["start"] - 1)) > threshold)
    pieces = F.transform(pieces, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    peaks = F.filter(F.transform(_peaks(steps, threshold), bare), lambda p: p["end"] - p["start"] >= min_length)
    return _merged(F.concat(pieces, peaks))


def _added(table: list[float], min_length: int, threshold: float) -> Column:
    """Secret runs and parts of runs; of a run that base spans touch only parts, and not what one of them covers."""
    base, runs = F.col("base"), F.col("runs")
    touched = lambda r: F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    covered = lambda r: F.exists(base, lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"]))

    def secret(run: Column) -> Column:
        r, steps = run["r"], run["steps"]
        whole = F.array(F.struct(F.lit(0).alias("start"), F.length(r["value"]).alias("end")))
        found = F.when((_mean(steps) > threshold) & ~run["touched"], whole).otherwise(_parts(r["value"], steps, min_length, threshold))
        return F.transform(
            found,
            lambda p: F.struct(
                (r["start"] + p["start"]).alias("start"), F.lit(MARKOV).alias("kind"), (r["start"] + p["end"]).alias("end"),
                F.substr(r["value"], p["start"] + 1, p["end"] - p["start"]).alias("value"),
            ),
        )

    scored = F.transform(
        F.filter(runs, lambda r: ~covered(r)),
        lambda r: F.struct(r.alias("r"), _steps(r["value"], table).alias("steps"), touched(r).alias("touched")),
    )
    return F.array_sort(F.filter(F.flatten(F.transform(scored, secret)), lambda s: ~covered(s)))


def find_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    samples: DataFrame | None = None,
    min_length: int = 16,
    threshold: float = 0.25,
) -> DataFrame:
    """One row for each row of ``df``: ``doc_id``, ``base`` and ``added`` spans, arrays of (start, kind, end, value).

    ``samples(value, label)`` trains the models (1: random string, 0: ordinary
    identifier); without it, ``train_on_corpus`` does. Added
    spans are runs of at least ``min_length`` token characters whose ratio exceeds
    ``threshold`` and that overlap no base span; of other runs, the parts of that
    length that exceed it (a key behind a path or an option's name, a longer key around
    a base span) and that no base span covers. Null and empty texts have no spans;
    repeated rows and null ids stay rows of their own; other columns are not carried.
    """
    docs = documents(df, id_col, text_col)
    table = train_on_corpus(docs) if samples is None else train(samples)
    scan = _scan(docs, min_length)
    return scan.select("doc_id", F.array_sort("base").alias("base"), _added(table, min_length, threshold).alias("added"))


def span_digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in [*BASE, "markov"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(
    df: DataFrame, text_col: str = "text", *, mask: str = "[secret]", samples: DataFrame | None = None,
    min_length: int = 16, threshold: float = 0.25,
) -> DataFrame:
    """``df``, all its columns, with the spans found in ``text_col`` replaced by ``mask``.

    Spans that overlap become one mask. A null text stays null and a text without
    spans stays as it is. The models are trained in a first pass; the second is one
    narrow projection, so repeated rows and null ids need no care.
    """
    table = train_on_corpus(df.select(F.col(text_col).alias("text"))) if samples is None else train(samples)
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc_id"), F.col(text_col).alias("text"))
    scan = _scan_with_text(row, min_length)
    spans, text = F.array_sort(F.concat("base", _added(table, min_length, threshold))), F.col("text")

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, more).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    clean = F.when(F.size(spans) > 0, done).otherwise(text)
    return scan.select(*((clean if c == text_col else F.col("doc_id")[c]).alias(c) for c in df.columns))
