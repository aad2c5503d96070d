"""The corpus pipeline: each stage reads what its predecessor kept.

All but the last stage return the columns of ``documents``. Rows with a null id pass
the stages that decide by id; null texts pass as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relinker.llm.common import scratch, table
from relinker.llm.decontaminate import drop_contaminated
from relinker.llm.packing import pack_documents
from relinker.llm.quality import drop_low_quality
from relinker.llm.secrets import redact
from relinker.llm.simhash import drop_near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose text the classifier rejects (a probability of label 1 under 0.3)."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs, words=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked in the text; ``n_chars`` follows."""
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again.

    What a stage wrote for itself goes when its rows are written, and the stages' rows go
    when the last ones are.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:
        for _, stage in STAGES[:-1]:
            with scratch(spark) as hold:
                docs = hold(stage(spark, docs, sf_dir))
        return keep(STAGES[-1][1](spark, docs, sf_dir))


#: Not expressible: a trained network, fingerprints and a tokenizer decide.
ORACLE_SQL = None
