"""Files to pools and back. Reads stay lazy, so filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathwise.functions.model import Alphabet, SequenceConfig, SequencePool, uncovered

CODECS = ("lz4", "uncompressed", "snappy", "gzip", "brotli", "zstd")


def load_dataframe(df: DataFrame, config: SequenceConfig | None = None, alphabet: Alphabet | None = None, drop_nulls: bool = False) -> SequencePool:
    """A pool of ``df``; a given alphabet must cover every state."""
    config = config or SequenceConfig()
    pool = SequencePool(df, config, alphabet)
    if drop_nulls:
        pool = SequencePool(df.dropna(subset=[config.state_column]), config, alphabet)
    if alphabet is not None and (extra := [r.state for r in uncovered(pool.data, config, alphabet).limit(10).collect()]):
        raise ValueError(f"States not in alphabet: {sorted(extra)}")
    return pool


def load_csv(spark: SparkSession, path: str, config: SequenceConfig | None = None, **options) -> SequencePool:
    return load_dataframe(spark.read.options(**{"header": True, "inferSchema": True, **options}).csv(path), config)


def load_parquet(spark: SparkSession, path: str, config: SequenceConfig | None = None, **options) -> SequencePool:
    return load_dataframe(spark.read.options(**options).parquet(path), config)


def load_json(spark: SparkSession, path: str, config: SequenceConfig | None = None) -> SequencePool:
    """JSON lines, one array of records, or one object of equally long columns."""
    df = spark.read.option("multiLine", _is_document(spark, path)).json(path)
    if df.columns and all(isinstance(f.dataType, T.ArrayType) for f in df.schema.fields):
        zipped = F.arrays_zip(*(F.col(f"`{c}`").alias(c) for c in df.columns))
        df = df.select(F.explode(zipped).alias("r")).select("r.*")
    return load_dataframe(df, config)


def _is_document(spark: SparkSession, path: str) -> bool:
    """Whether the first line does not hold a whole record."""
    first = [r.value for r in spark.read.text(path).where(F.trim("value") != "").limit(1).collect()]
    line = first[0].strip() if first else ""
    return line.startswith("[") or not line.endswith("}") or spark.read.text(path).where(F.trim("value") != "").limit(2).count() == 1


def save_csv(seq, path: str, **options) -> None:
    seq.data.write.options(**{"header": True, **options}).mode("overwrite").csv(path)


def save_json(seq, path: str) -> None:
    seq.data.write.mode("overwrite").json(path)


def save_parquet(seq, path: str, compression: str = "zstd", **options) -> None:
    if compression not in CODECS:
        raise ValueError(f"Unknown compression: {compression!r}")
    seq.data.write.options(**{"compression": compression, **options}).mode("overwrite").parquet(path)
