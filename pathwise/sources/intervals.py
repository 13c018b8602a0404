"""Interval tables sampled on a grid of times: a backward as-of join."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.functions.model import SequenceConfig, StateSequence, is_temporal


def sample_intervals(
    df: DataFrame,
    id_column: str = "id",
    start_column: str = "start",
    end_column: str = "end",
    state_column: str = "state",
    time_points: Sequence[Any] | DataFrame | None = None,
    config: SequenceConfig | None = None,
    check: bool = True,
) -> StateSequence:
    """The state of every id at each time point that its latest-starting interval [start, end) covers.

    Of intervals with one start the one with the latest end, then the greatest state, counts; intervals
    with a null start or end are void. Integer times have a default grid from the least start to the
    greatest end: an interval's steps up to its end or the next start, without the steps that nothing
    covers. Given times and the intervals are merged into one table and the latest interval is carried
    forward by a window. Either way an id is shuffled and sorted once and nothing is compared pair by pair.
    """
    config = config or SequenceConfig()
    for c in (id_column, start_column, end_column, state_column):
        if c not in df.columns:
            raise ValueError(f"Missing required column: {c}")
    iv = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{start_column}`").alias("start"), F.col(f"`{end_column}`").alias("end"), F.col(f"`{state_column}`").alias("state"))
    if check and iv.where("end < start").take(1):
        raise ValueError("an interval ends before it starts")
    iv, kind = iv.where("start is not null and end is not null"), iv.schema["start"].dataType
    i, t, s = config.columns
    if time_points is None:
        if is_temporal(kind):
            raise ValueError("temporal intervals need explicit time_points")
        after = F.lead("start").over(Window.partitionBy("id").orderBy("start", "end", "state"))
        spans = iv.select("id", "start", F.least("end", after).alias("stop"), "state").where("start < stop")
        rows = spans.select("id", F.explode(F.sequence("start", F.col("stop") - 1)).alias("time"), "state")
        return StateSequence(rows.select(F.col("id").alias(i), F.col("time").alias(t), F.col("state").alias(s)), config)
    points = time_points if isinstance(time_points, DataFrame) else df.sparkSession.createDataFrame([(x,) for x in sorted(set(time_points))], f"time {kind.simpleString().replace('_ntz', '')}")
    points = points.select(F.col(points.columns[0]).cast(kind).alias("time"))
    grid = iv.select("id").distinct().crossJoin(F.broadcast(points))
    none = F.lit(None)
    span = F.struct("start", "end", "state")
    starts = iv.select("id", F.col("start").alias("time"), span.alias("iv"), F.lit(0).alias("asked"))
    asked = grid.select("id", "time", none.cast(starts.schema["iv"].dataType).alias("iv"), F.lit(1).alias("asked"))
    # A null struct sorts first, so of one start the greatest interval comes last before the questions.
    w = Window.partitionBy("id").orderBy("time", "asked", "iv").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = starts.unionByName(asked).withColumn("last", F.last("iv", ignorenulls=True).over(w))
    rows = seen.where("asked = 1 and time < last.end")
    return StateSequence(rows.select(F.col("id").alias(i), F.col("time").alias(t), F.col("last.state").alias(s)), config)
