"""A training-data pipeline of five stages; each is written as Parquet and read again by the next.

A stage gets the rows its predecessor kept. Rejected documents are gone, cut or masked text stays
cut or masked; the last stage returns the token ids of what is left.

Defined cases: documents with null or empty text, or without a letter, go at language_id; null doc_ids
take part everywhere; of repeated rows near_dedup keeps one; texts of any length are taken whole; without
a learnable language nothing is left; an empty table gives an empty result of the same columns; further
columns of documents, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from minnow.llm import bpe, decontaminate, langid, neardup, secrets
from minnow.llm.cluster import stored, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: A prediction under this posterior is no language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a recognisable language stay."""
    return langid.recognised(docs, langid.train(docs), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return neardup.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of several benchmark items go; a passage of one item is cut out."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and their checks."""
    return bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, ("ids",))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", secrets_masked),
    ("byte_bpe", encoded),
]

#: Naive Bayes, sampled signatures and BPE are not SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
