"""Frequent subsequences with gaps, and rules between a pattern's parts."""

from __future__ import annotations

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.functions.runtime import materialise


def frequent_subsequences(seq, min_support: float = 0.1, max_length: int = 5, min_length: int = 1) -> DataFrame:
    """subsequence, support (sequences that contain it) and proportion, ordered by support, then pattern.

    Patterns are mined by prefix projection over the cluster. The least count is floor(min_support * n), at least 1.
    """
    n = seq.n_sequences()
    if not n:
        return seq.spark.createDataFrame([], "subsequence array<string>, support long, proportion double")
    least = max(1, int(min_support * n))
    items = seq.sequences.select(F.transform(F.filter("states", lambda s: s.isNotNull()), lambda s: F.array(s)).alias("sequence"))
    found = PrefixSpan(minSupport=max(0.0, (least - 0.5) / n), maxPatternLength=max_length).findFrequentSequentialPatterns(items)
    out = found.select(F.flatten("sequence").alias("subsequence"), F.col("freq").alias("support"), (F.col("freq") / F.lit(n)).alias("proportion"))
    return out.where(F.size("subsequence") >= min_length).orderBy(F.desc("support"), "subsequence")


def association_rules(seq, min_support: float = 0.1, min_confidence: float = 0.0, max_length: int = 5) -> DataFrame:
    """antecedent => consequent for every split of a frequent pattern, with the usual measures."""
    patterns = materialise(frequent_subsequences(seq, min_support, max_length).select("subsequence", F.col("proportion").alias("s")))
    size = F.size("subsequence")
    splits = patterns.where(size >= 2).select(F.col("s").alias("support"), "subsequence", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    splits = splits.select("support", F.slice("subsequence", 1, F.col("k")).alias("antecedent"), F.slice("subsequence", F.col("k") + 1, F.size("subsequence")).alias("consequent"))
    a, b = (patterns.select(F.col("subsequence").alias(x), F.col("s").alias(y)) for x, y in (("antecedent", "sa"), ("consequent", "sb")))
    rules = splits.join(a, "antecedent").join(b, "consequent").withColumn("confidence", F.col("support") / F.col("sa")).where(F.col("confidence") >= min_confidence)
    conviction = F.when(F.col("confidence") >= 1, float("inf")).otherwise((1 - F.col("sb")) / F.when(F.col("confidence") < 1, 1 - F.col("confidence")))
    out = rules.select("antecedent", "consequent", "support", "confidence", (F.col("confidence") / F.col("sb")).alias("lift"), (F.col("support") - F.col("sa") * F.col("sb")).alias("leverage"), conviction.alias("conviction"))
    return out.orderBy(F.desc("confidence"), F.desc("lift"), "antecedent", "consequent")
