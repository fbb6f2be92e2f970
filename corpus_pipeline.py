"""The corpus pipeline: language ID, exact and near deduplication, PII masking, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressdelta.llm.common import materialize
from pressdelta.llm.exact_dedup import drop_exact_copies
from pressdelta.llm.langid import keep_identified
from pressdelta.llm.neardup import drop_near_similar
from pressdelta.llm.packing import best_fit_packing
from pressdelta.llm.pii import mask_pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more the smallest doc_id stays.

    The similarity is that of the texts' sets of five-word shingles.
    """
    return drop_near_similar(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind."""
    return mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their tokens, in bins of the permitted sequence lengths."""
    return best_fit_packing(docs, content=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mask_personal_data", mask_personal_data),
    ("pack", pack),
]

#: Trained models and fingerprints are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
