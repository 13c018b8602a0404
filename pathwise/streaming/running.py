"""Structured Streaming over long tables. The batch operators have no streaming counterpart in scope; these
two keep counts up to date as files of observations arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from pathwise.functions.model import SequenceConfig


def observations(spark: SparkSession, path: str, schema: StructType, config: SequenceConfig | None = None, max_files: int = 100) -> DataFrame:
    """(id, time, state) of Parquet files as they appear in a folder."""
    config = config or SequenceConfig()
    i, t, s = (F.col(f"`{c}`") for c in config.columns)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return stream.select(i.alias("id"), t.alias("time"), s.cast("string").alias("state"))


def running_state_counts(stream: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Observations of each state in tumbling windows; later rows than ``delay`` are left out."""
    return stream.withWatermark("time", delay).groupBy(F.window("time", window), "state").agg(F.count("*").alias("count"))


def running_transitions(stream: DataFrame) -> DataFrame:
    """(id, from_state, to_state) of each sequence across micro-batches. The state of a sequence is its last observation.

    A row older than what its sequence has already passed is left out.
    """
    kind = stream.schema["id"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_time, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["time", "state"])
        moves = []
        for t, s in zip(rows["time"].astype("int64"), rows["state"]):
            if last_time is not None and t < last_time:
                continue
            if last is not None and s is not None:
                moves.append((key[0], last, s))
            last_time, last = int(t), s
        if last_time is not None:
            state.update((last_time, last))
        yield pd.DataFrame(moves, columns=["id", "from_state", "to_state"])

    return stream.groupBy("id").applyInPandasWithState(step, f"id {kind}, from_state string, to_state string", "time long, state string", "append", GroupStateTimeout.NoTimeout)
