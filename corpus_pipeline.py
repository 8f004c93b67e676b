"""The corpus pipeline: five stages, each a function of (spark, docs, sf_dir), over the whole table of documents.

Each stage reads what the one before kept and returns the columns of documents;
the last adds `copy`, which counts the copies of a document from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, language_id, minhash_dedup, secret_scan, source_mixing
from granary.llm._shared import documents, durable


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts and texts without letters."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near-duplicate texts, that of the least id; a text like no other stays, whatever its id."""
    return minhash_dedup.one_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose text covers enough of a benchmark item."""
    return decontaminate.keep_clean(docs, documents(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; n_chars follows where a text changes."""
    return secret_scan.redact(docs, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit each document as often as the target weights of its source ask for."""
    return source_mixing.mixed(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
]
#: Signatures, tiling and decoded keys are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
