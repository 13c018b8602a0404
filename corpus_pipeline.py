"""A corpus pipeline of five stages over ``documents``; each stage is one of the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwise.llm import bpe, decontaminate, near_dup, quality, secret_scan
from pathwise.llm.queries import table
from pathwise.llm.runtime import bound_batches, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    bound_batches(spark)
    return quality.keep(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    bound_batches(spark)
    return near_dup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Test passages are cut from texts; documents that are mostly test passages go."""
    bound_batches(spark)
    return _measured(decontaminate.remove(docs, table(spark, sf_dir, "benchmark")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark."""
    bound_batches(spark)
    return _measured(secret_scan.redact(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's token ids, and their digests."""
    bound_batches(spark)
    return bpe.encode_with_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that was cut."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE", byte_bpe),
]
#: SQL does not express the join, the expectation-maximisation or the encoding; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
