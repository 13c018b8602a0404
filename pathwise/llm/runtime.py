"""Shared run-time helpers: materialised tables and bounded collects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwise.functions.runtime import materialise

__all__ = ["bound_batches", "collect_bounded", "materialise", "neutral"]

#: Rows and bytes of an Arrow batch of texts. Spark's defaults let a batch of long texts, which both the
#: executor and its Python workers hold several times over, take hundreds of MB.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to what texts need; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        digits = "".join(c for c in now or "" if c.isdigit())
        if not digits or not now.isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


def collect_bounded(df: DataFrame, bound: int, what: str) -> list:
    """Collect a table whose row count has a proven bound; fail loudly if the proof was wrong."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what}: more than {bound} rows")
    return rows


def neutral(df: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``df`` with every column but those to keep named by its place, so no name clashes with a helper's.

    Also the columns that give the old names and order back.
    """
    new = {c: c if c in keep else f"c{k}" for k, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in new.items())), [F.col(n).alias(c) for c, n in new.items()]
