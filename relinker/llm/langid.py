"""Language identification in two steps: the family first, then the language within it.

Both steps are one-versus-one linear support vector machines over hashed byte n-grams
of normalised text, trained by Pegasos on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relinker.llm.common import ship
from relinker.llm.decontaminate import normal

#: Families; a language in none of them is its own family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
}
BUCKETS = 4096
#: Languages to learn; their pairs make machines in the driver.
MOST_LANGUAGES = 256
_CHUNK = 1 << 20


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte 2- and 3-grams of the whole normalised text; unit length."""
    data = f" {normal(text)} ".encode("utf-8", "surrogatepass")
    counts = np.zeros(BUCKETS)
    for at in range(0, len(data), _CHUNK):
        b = np.frombuffer(data[at : at + _CHUNK + 2], np.uint8).astype(np.uint32)
        two = b[:-1] << 8 | b[1:]
        three = two[:-1] << 8 | b[2:]
        for gram in (two + np.uint32(0x51ED270B), three):
            counts += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    return np.sqrt(counts / max(1.0, counts.sum()))


def pegasos(x: np.ndarray, y: np.ndarray, rounds: int = 12, weight: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM: hinge loss, L2, averaged over the second half of the steps."""
    rng, x = np.random.default_rng(0), np.hstack([x, np.ones((len(x), 1))])
    w, total, kept, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, 0
    share = {s: 0.5 / max(1, int((y == s).sum())) * len(y) for s in (-1, 1)}
    batch = 32
    steps = rounds * -(-len(x) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            t += 1
            some = order[i : i + batch]
            rate = 1 / (weight * (t + 1000))
            bad = y[some] * (x[some] @ w) < 1
            pull = np.array([share[s] for s in y[some][bad]]) * y[some][bad]
            w = (1 - rate * weight) * w + rate / len(some) * (pull @ x[some][bad])
            if 2 * t > steps:
                total, kept = total + w, kept + 1
    return total / max(1, kept)


@dataclass
class Voters:
    """One-versus-one machines between ``names``."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def train(cls, x: np.ndarray, labels: np.ndarray) -> Voters:
        names = sorted(set(labels.tolist()))
        pairs = list(combinations(range(len(names)), 2))
        rows = []
        for i, j in pairs:
            mine = (labels == names[i]) | (labels == names[j])
            rows.append(pegasos(x[mine], np.where(labels[mine] == names[i], 1, -1)))
        return cls(names, pairs, np.array(rows, np.float64).reshape(len(pairs), x.shape[1] + 1))

    def vote(self, x: np.ndarray) -> tuple[str, float]:
        """The name with the largest mean probability against each other one (ties: the first by name)."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        p = 1 / (1 + np.exp(-np.clip(3 * (self.weights[:, :-1] @ x + self.weights[:, -1]), -30, 30)))
        score = np.zeros(len(self.names))
        for (i, j), q in zip(self.pairs, p):
            score[i] += q
            score[j] += 1 - q
        score /= len(self.names) - 1
        best = int(np.argmax(score))
        return self.names[best], float(score[best])


@dataclass
class Identifier:
    family: Voters
    within: dict[str, Voters]

    @classmethod
    def train(cls, x: np.ndarray, langs: np.ndarray, families=FAMILIES) -> Identifier:
        of = {lang: name for name, some in families.items() for lang in some}
        groups = np.array([of.get(lang, lang) for lang in langs.tolist()])
        within = {g: Voters.train(x[groups == g], langs[groups == g]) for g in sorted(set(groups.tolist()))}
        return cls(Voters.train(x, groups), within)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.within:
            return "und", 0.0
        x = features(text)
        family, p = self.family.vote(x)
        lang, q = self.within[family].vote(x)
        return lang, p * q


def train(labelled: DataFrame, max_samples: int, families=FAMILIES) -> Identifier | None:
    """An identifier from ``labelled(doc_id, text, lang)``; None without a usable row.

    About ``max_samples`` rows of each language are used, chosen by the hash of their
    id, so the choice depends on no order; their features, not their texts, come to
    the driver. Rows with a null language, or without a letter, teach nothing. More than
    ``MOST_LANGUAGES`` are an error, as machines grow with the square of their number.
    """
    ship(labelled.sparkSession)
    rows = labelled.filter("lang IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages to learn: a machine for each pair of a family is too much")
    if not counts:
        return None
    share = F.create_map(*(F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, max_samples / n))))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6 < F.element_at(share, F.col("lang"))

    def featured(batches):
        for batch in batches:
            keep = [has_letter(t) for t in batch["text"]]
            vectors = [features(t).astype(np.float16).tobytes() for t in batch["text"][keep]]
            yield pd.DataFrame({"lang": batch["lang"][keep].tolist(), "vector": vectors})

    got = rows.filter(drawn).select("text", "lang").mapInPandas(featured, "lang string, vector binary").collect()
    if not got:
        return None
    got = sorted(got, key=lambda r: (r.lang, bytes(r.vector)))
    x = np.frombuffer(b"".join(bytes(r.vector) for r in got), np.float16).reshape(len(got), BUCKETS).astype(np.float32)
    return Identifier.train(x, np.array([r.lang for r in got], dtype=object), families)


def identify(docs: DataFrame, model: Identifier | None, text: Column) -> DataFrame:
    """``docs`` with ``prediction: struct<lang_pred, score>``; ``und`` and 0 without a letter, a text or a model."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages times buckets

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        rows = [m.predict(t) if m else ("und", 0.0) for t in texts]
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    return docs.withColumn("prediction", predicted(text))


def language_id(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
    folds: int = 3, held_fold: int = 1, max_samples: int = 800,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``df``.

    Held out: the crc32 of the id as text, modulo ``folds``, is ``held_fold``; the
    model learns from the others only. A null id is neither held out nor learned
    from. Null texts, and those without a letter, are ``und`` with score 0. Repeated
    rows stay; other columns are not carried.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_fold
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold.alias("held_out"))
    model = train(docs.filter("NOT held_out"), max_samples)
    out = identify(docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text"), model, F.col("text"))
    return out.select("doc_id", "held_out", "prediction.lang_pred", "prediction.score")
