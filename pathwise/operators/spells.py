"""Spells and the counts built on them: gaps and islands over one exchange and one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.functions.runtime import materialise


def marked(seq) -> DataFrame:
    """(id, time, state, change): change is true where a spell starts; a null state never continues one."""
    return seq.base.withColumn("change", F.coalesce(F.col("state") != F.lag("state").over(seq.window), F.lit(True)))


def spells(seq) -> DataFrame:
    """(id, spell, state, start, end, duration) with spells numbered from 1 in each sequence."""
    running = seq.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marked(seq).withColumn("spell", F.sum(F.col("change").cast("long")).over(running))
    return rows.groupBy("id", "spell").agg(F.min("state").alias("state"), F.min("time").alias("start"), F.max("time").alias("end"), F.count("*").alias("duration"))


def to_sps(seq, global_ids: bool = True) -> DataFrame:
    """id, spell_id, state, start, end, duration. Global ids run over all sequences in id order.

    The global number is the sequence's own number plus the spells of all lower ids. Those offsets are
    prefix sums over range partitions of the ids: only one total for each partition is summed in one place.
    """
    own = spells(seq)
    if not global_ids:
        return seq.named(own.select("id", F.col("spell").alias("spell_id"), "state", "start", "end", "duration"))
    counts = own.groupBy("id").agg(F.max("spell").alias("n"))
    parts = int(seq.spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(counts.repartitionByRange(parts, "id").withColumn("p", F.spark_partition_id()))
    inner = F.sum("n").over(Window.partitionBy("p").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    totals = ranged.groupBy("p").agg(F.sum("n").alias("t"))
    before = totals.withColumn("o", F.coalesce(F.sum("t").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = ranged.withColumn("i", F.coalesce(inner, F.lit(0))).join(F.broadcast(before.select("p", "o")), "p").select("id", (F.col("i") + F.col("o")).alias("offset"))
    out = own.join(offsets, "id").select("id", (F.col("spell") + F.col("offset")).alias("spell_id"), "state", "start", "end", "duration")
    return seq.named(out)


def to_dss(seq) -> DataFrame:
    """The first row of every spell with all its columns."""
    i, t, s = (F.col(f"`{c}`") for c in seq.config.columns)
    w = Window.partitionBy(i).orderBy(t, s)
    return seq.data.withColumn("_first", F.coalesce(s != F.lag(s).over(w), F.lit(True))).where("_first").drop("_first")


def durations(seq) -> DataFrame:
    return seq.named(spells(seq).orderBy("id", "spell").select("id", "state", "duration"))


def total_duration_by_state(seq) -> DataFrame:
    return seq.base.groupBy("state").agg(F.count("*").alias("total_duration")).orderBy(F.desc("total_duration"), "state")


def spells_per_sequence(seq) -> DataFrame:
    return seq.named(marked(seq).groupBy("id").agg(F.sum(F.col("change").cast("long")).alias("n_spells")))


def state_counts(seq) -> DataFrame:
    return seq.base.groupBy("state").agg(F.count("*").alias("count")).orderBy("state")


def state_per_sequence(seq, proportion: bool = False) -> DataFrame:
    counts = seq.base.groupBy("id", "state").agg(F.count("*").alias("count"))
    if not proportion:
        return seq.named(counts)
    share = F.col("count") / F.sum("count").over(Window.partitionBy("id"))
    return seq.named(counts.select("id", "state", share.alias("proportion")))


def span(seq) -> DataFrame:
    """id, first, last and span, the difference of times (an interval for temporal times)."""
    return seq.named(seq.base.groupBy("id").agg(F.min("time").alias("first"), F.max("time").alias("last")).withColumn("span", F.col("last") - F.col("first")))
