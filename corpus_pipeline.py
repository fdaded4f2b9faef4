"""From raw documents to packed training sequences: five stages, each a written table.

Every stage but the last returns the columns of ``documents``. SQL can't express the classifier or
the tokenizer, so there is no ``ORACLE_SQL``; tests hold the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.llm import decontaminate, minhash, packing, quality, secrets
from flowsift.llm.common import fresh, small_batches, stored, table

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labels, doesn't reject."""
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")
    return quality.score(docs, model, into=(score, predicted)).where(F.col(predicted) == 1).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return minhash.without_copies(docs, size=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    small_batches(spark)
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; ``n_chars`` follows the text."""
    spans = fresh(docs, "secret_spans")
    scanned = secrets.scan(docs, into=spans)
    masked = scanned.withColumn("text", secrets.masked(F.col("text"), F.col(spans)))
    changed = F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", changed).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
