"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Every token has a sparse random index vector that its hash gives. Over the whole
corpus, Spark adds up for each token the index vectors of its neighbours; a document
is the mean, spread and extremes of its tokens' vectors and how far neighbours agree;
a two-layer network gives the probability of label 1, calibrated by a temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relinker.llm.common import arrow_batches, documents

ROWS_BITS, DIMS, NONZERO = 14, 32, 3
ROWS = 1 << ROWS_BITS
_CHUNK = 1 << 19
#: Classes of bytes: 0 white space, 1 letter, 2 digit, 3 other; a token is a run of one class.
_CLASS = np.array([0 if b <= 32 else 1 if b > 127 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(_CHUNK + 1, _BASE, np.uint64))
    _INVERSE = np.cumprod(np.full(_CHUNK + 1, np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64))


def token_rows(text: str) -> np.ndarray:
    """The hash row of each token of a whole text, in order."""
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        if end < len(data):
            end = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end)) + 1 or end
            end = end if end > at else min(len(data), at + _CHUNK)
        b = np.frombuffer(data, np.uint8, end - at, at)
        kind = _CLASS[b]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(b)]))
        real = kind[starts] != 0
        starts, ends = starts[real], ends[real]
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWER[: len(b)])))
            h = (sums[ends] - sums[starts]) * _INVERSE[starts]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(64 - ROWS_BITS)).astype(np.int64))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each row's index vector."""
    rng = np.random.default_rng(20)
    places = np.argsort(rng.random((ROWS, DIMS)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1.0, 1.0]), (ROWS, NONZERO))


_PLACES, _SIGNS = _index_vectors()


def context_sums(tokens: np.ndarray) -> np.ndarray:
    """Sums (ROWS, DIMS) of the index vectors of each token's two neighbours; -1 is a text's end."""
    total = np.zeros(ROWS * DIMS)
    for mine, other in ((tokens[1:], tokens[:-1]), (tokens[:-1], tokens[1:])):
        real = (mine >= 0) & (other >= 0)
        base, other = mine[real] * DIMS, other[real]
        for k in range(NONZERO):
            total += np.bincount(base + _PLACES[other, k], weights=_SIGNS[other, k], minlength=ROWS * DIMS)
    return total.reshape(ROWS, DIMS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors (ROWS, DIMS) from all rows of ``docs(text)``.

    Each task adds up its own rows; Spark sums them by hash row. What reaches the
    driver is the table, ``ROWS * DIMS`` numbers whatever the corpus.
    """
    names = [f"c{i}" for i in range(DIMS)]

    def sums(batches):
        total = np.zeros((ROWS, DIMS))
        waiting, size = [], 0
        stop = np.array([-1], np.int64)
        for batch in batches:
            for text in batch["text"]:
                t = token_rows(text)
                waiting += [t, stop]
                size += len(t)
                if size > 500_000:
                    total += context_sums(np.concatenate(waiting))
                    waiting, size = [], 0
        if waiting:
            total += context_sums(np.concatenate(waiting))
        met = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pd.DataFrame(total[met].astype(np.int64), columns=names).assign(row=met.astype(np.int32))[["row", *names]]

    schema = "row int, " + ", ".join(f"{c} long" for c in names)
    added = docs.select("text").mapInPandas(sums, schema).groupBy("row").agg(*(F.sum(c).alias(c) for c in names))
    table, out = added.toPandas(), np.zeros((ROWS, DIMS), np.float32)
    if len(table):
        v = table[names].to_numpy(np.float64)
        out[table["row"].to_numpy()] = v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
    return out


LAGS = (1, 2)
WIDE = 4 * DIMS + 2 * len(LAGS)


def _agreement(rows: np.ndarray, vectors: np.ndarray, lag: int) -> tuple[float, float]:
    """Mean product of the vectors of tokens ``lag`` apart, and how often they are one token."""
    n, product = len(rows) - lag, 0.0
    if n <= 0:
        return 0.0, 0.0
    for at in range(0, n, 1 << 14):
        left, right = rows[at : min(n, at + (1 << 14))], rows[at + lag : min(n, at + (1 << 14)) + lag]
        product += float(np.einsum("ij,ij->", vectors[left], vectors[right]))
    return product / n, float(np.mean(rows[lag:] == rows[:-lag]))


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread, least and greatest of the vectors of a text's tokens, and the agreement of tokens near each other.

    Zeros without a token.
    """
    rows = token_rows(text)
    if not len(rows):
        return np.zeros(WIDE, np.float32)
    met, many = np.unique(rows, return_counts=True)
    v, share = vectors[met], (many / len(rows)).astype(np.float32)
    mean = share @ v
    near = np.array([x for lag in LAGS for x in _agreement(rows, vectors, lag)], np.float32)
    return np.concatenate([mean, np.sqrt(np.maximum(0, share @ (v * v) - mean * mean)), v.min(axis=0), v.max(axis=0), near])


@dataclass
class Network:
    """Standardised input, one hidden layer of rectified units, one logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on the log loss; a fifth of the rows sets the temperature only. Without both labels, a constant."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    tune, learn = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    net = Network(mean, scale, rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    if len(set(y.tolist())) < 2:
        net.w2[:] = 0
        net.b2 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return net
    z, target = (x[learn] - mean) / scale, y[learn]
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(z)), max(1, len(z) // 64)):
            step += 1
            pre = z[some] @ params[0] + params[1]
            act = np.maximum(0, pre)
            p = 1 / (1 + np.exp(-np.clip(act @ params[2] + params[3], -40, 40)))
            d = (p - target[some]) / len(some)
            back = np.outer(d, params[2]) * (pre > 0)
            grads = [z[some].T @ back + 1e-3 * params[0], back.sum(axis=0), act.T @ d + 1e-3 * params[2], d.sum(keepdims=True)]
            for i, g in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.999 * m2[i] + 0.001 * g * g
                params[i] -= 2e-3 * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *params[:3], float(params[3][0])
    if len(tune):
        logit, t = net.logits(x[tune]), y[tune]
        loss = lambda k: np.mean(np.logaddexp(0, logit / k) - t * logit / k)
        net.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return net


def _trained(docs: DataFrame, labels: DataFrame, label_id: str, label_col: str, folds: int, held_fold: int, max_samples: int):
    """The word vectors (broadcast), a column that tells which ids are held out, and the network.

    Only the texts of the drawn labelled rows are pooled; their ids, ``max_samples`` or
    so at most, are broadcast.
    """
    with arrow_batches(docs.sparkSession):
        shared = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))  # bounded: ROWS * DIMS

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([pooled(t, shared.value).astype(np.float16).tobytes() for t in texts], dtype=object)

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    marks = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).alias("label")).filter("label IN (0, 1)").distinct()
    ids = docs.filter(~held).select("doc_id")
    share = max_samples / max(1, ids.join(marks, "doc_id").count())
    drawn = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6 < share).join(ids.distinct(), "doc_id", "left_semi")
    with arrow_batches(docs.sparkSession):
        rows = docs.filter(~held).join(F.broadcast(drawn), "doc_id").select(vector("text").alias("vector"), "label").collect()
    rows = sorted((bytes(r.vector), r.label) for r in rows)
    net = fit(_matrix(v for v, _ in rows), np.array([y for _, y in rows], np.float64))
    return shared, held, net


def _probability(texts: pd.Series, vectors: np.ndarray, net: Network) -> np.ndarray:
    """Of each text (null: empty), through the same rounding as in training."""
    if not len(texts):
        return np.empty(0)
    return net.probability(_matrix(pooled(t or "", vectors).astype(np.float16).tobytes() for t in texts))


def _matrix(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float16).reshape(-1, WIDE).astype(np.float64)


def quality_scores(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_col: str = "quality",
    label_id: str = "doc_id", folds: int = 5, held_fold: int = 0, threshold: float = 0.3, max_samples: int = 12_000,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``df``.

    Held out: the crc32 of the id as text, modulo ``folds``, is ``held_fold``; labels
    are learned from other rows only, about ``max_samples`` of them, chosen by the hash
    of their id. Word vectors come from all texts. Null and empty texts have no token
    and get the score of a zero vector. A null id is not held out and teaches nothing;
    null labels and those other than 0 and 1 teach nothing; repeated rows count each.
    """
    docs = documents(df, id_col, text_col)
    shared, held, net = _trained(docs, labels, label_id, label_col, folds, held_fold, max_samples)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_probability(texts, shared.value, net), dtype=float)

    scored = docs.select("doc_id", held.alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_low_quality(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_col: str = "quality",
    label_id: str = "doc_id", folds: int = 5, held_fold: int = 0, threshold: float = 0.3, max_samples: int = 12_000,
) -> DataFrame:
    """``df``, all its columns, without the rows whose text scores under ``threshold``.

    The model is that of ``quality_scores``; each text is scored where it lies, so no
    text is shuffled and null ids are judged like any other. A null text is empty.
    """
    shared, _, net = _trained(documents(df, id_col, text_col), labels, label_id, label_col, folds, held_fold, max_samples)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(_probability(texts, shared.value, net) >= threshold, dtype=bool)

    return df.filter(good(F.col(text_col)))
