"""The opN queries over the intended tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pathwise.llm import bpe, decontaminate, license_scan, near_dup, pst, quality, secret_scan, sharding, toxicity, url_filter
from pathwise.llm.runtime import bound_batches, materialise

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op3_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.join(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("quality_probability")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


#: An earlier state of the rules, in another order: a rule of a former version, one since removed, one not there yet.
FORMER_RULES = (
    secret_scan.Rule("hex", 0, "[0-9a-f]{8,}"),
    *(r for r in secret_scan.RULES if r.name not in ("hex", "jwt")),
    secret_scan.Rule("removed", 1, "[A-Z]{6,}", base=False),
)


def secret_ledger_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of the secret scan's ledger: all blobs with the former rules, then what the current ones lack."""
    docs = table(spark, sf_dir, "documents")
    ledger = materialise(secret_scan.extend(docs.select("text"), None, FORMER_RULES))
    return secret_scan.report(docs, ledger=ledger)


ORACLES: dict[str, str] = {
    "op1_decontamination": decontaminate.ORACLE,
    "op2_sharding": sharding.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op9_quality_rules": quality.oracle(),
    "op10_secret_scan": secret_scan.oracle(),
    "secret_ledger_rounds": secret_scan.oracle(),
}

QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_suffix_tree_scores": op3_suffix_tree_scores,
    "op4_url_filter": op4_url_filter,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_toxicity": op6_toxicity,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "secret_ledger_rounds": secret_ledger_rounds,
}
