"""Normative indicators: states are positive, negative or neutral."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwise.operators.descriptive import reduced


def _in(states: Sequence[str]) -> Column:
    return F.coalesce(F.col("state").isin(*states), F.lit(False)) if states else F.lit(False)


def _sign(positive: Sequence[str], negative: Sequence[str]) -> Column:
    return F.when(_in(positive), 1).when(_in(negative), -1).otherwise(0)


def _over_pairs(hits: Column) -> Column:
    """A count over adjacent pairs, divided by their number."""
    n = F.count("*")
    return F.when(n > 1, F.sum(hits.cast("double")) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)


def individual_state_distribution(seq) -> DataFrame:
    """id, state, count, proportion for every sequence and every state of the alphabet."""
    ids = seq.base.groupBy("id").agg(F.count("*").alias("n"))
    grid = ids.withColumn("state", F.explode(F.array(*map(F.lit, seq.alphabet.states)).cast("array<string>")))
    counts = seq.base.groupBy("id", "state").agg(F.count("*").alias("count"))
    out = grid.join(counts, ["id", "state"], "left").select("id", "state", F.coalesce("count", F.lit(0)).alias("count"), (F.coalesce("count", F.lit(0)) / F.col("n")).alias("proportion"))
    return seq.named(out)


def _share(seq, states: Sequence[str], name: str, per_sequence: bool):
    return reduced(seq, seq.base.groupBy("id").agg(F.avg(_in(states).cast("double")).alias(name)), name, per_sequence)


def proportion_positive(seq, positive_states: Sequence[str], per_sequence: bool = False):
    return _share(seq, positive_states, "proportion_positive", per_sequence)


def badness(seq, negative_states: Sequence[str], per_sequence: bool = False):
    return _share(seq, negative_states, "badness", per_sequence)


def _signed(seq, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    rows = seq.base.withColumn("sign", _sign(positive, negative))
    return rows.withColumn("prev", F.lag("sign").over(seq.window))


def volatility(seq, positive_states: Sequence[str], negative_states: Sequence[str], per_sequence: bool = False):
    """Share of adjacent pairs that go from one sign to the other."""
    hits = F.coalesce(F.col("sign") * F.col("prev") == -1, F.lit(False))
    out = _signed(seq, positive_states, negative_states).groupBy("id").agg(_over_pairs(hits).alias("volatility"))
    return reduced(seq, out, "volatility", per_sequence)


def degradation(seq, positive_states: Sequence[str], negative_states: Sequence[str], per_sequence: bool = False):
    """Share of adjacent pairs that fall from positive to negative."""
    hits = F.coalesce((F.col("prev") == 1) & (F.col("sign") == -1), F.lit(False))
    out = _signed(seq, positive_states, negative_states).groupBy("id").agg(_over_pairs(hits).alias("degradation"))
    return reduced(seq, out, "degradation", per_sequence)


def objective_volatility(seq, w: float = 0.5, per_sequence: bool = False):
    """w times the share of further states visited plus 1 - w times the share of transitions."""
    if not 0 <= w <= 1:
        raise ValueError("w must be in [0, 1]")
    k = len(seq.alphabet)
    rows = seq.base.withColumn("moved", F.coalesce(F.col("state") != F.lag("state").over(seq.window), F.lit(False)))
    n = F.count("*")
    value = w * (F.count_distinct("state") - 1) / max(1, k - 1) + (1 - w) * F.sum(F.col("moved").cast("double")) / F.greatest(n - 1, F.lit(1))
    out = rows.groupBy("id").agg((F.when(n > 1, value).otherwise(0.0) if k > 1 else F.lit(0.0)).alias("objective_volatility"))
    return reduced(seq, out, "objective_volatility", per_sequence)


def precarity(seq, negative_states: Sequence[str], per_sequence: bool = False):
    """Negative states weighted by their place from 1, over the sum of all places."""
    rows = seq.base.withColumn("pos", F.row_number().over(seq.window)).withColumn("neg", _in(negative_states).cast("int"))
    n = F.count("*")
    out = rows.groupBy("id").agg((F.sum(F.col("pos") * F.col("neg")) / (n * (n + 1) / 2)).alias("precarity"))
    return reduced(seq, out, "precarity", per_sequence)


def insecurity(seq, negative_states: Sequence[str], per_sequence: bool = False):
    """Mean over places of the share of negative states from there on."""
    ahead = seq.window.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = seq.base.withColumn("share", F.avg(_in(negative_states).cast("double")).over(ahead))
    return reduced(seq, rows.groupBy("id").agg(F.avg("share").alias("insecurity")), "insecurity", per_sequence)


def integration(seq, positive_states: Sequence[str] | None = None, per_sequence: bool = False):
    """Mean over places of the share of positive states up to there; without states, of each alphabet state."""
    behind = seq.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if positive_states is not None:
        rows = seq.base.withColumn("share", F.avg(_in(positive_states).cast("double")).over(behind))
        return reduced(seq, rows.groupBy("id").agg(F.avg("share").alias("integration")), "integration", per_sequence)
    states = seq.alphabet.states
    shares = [F.avg(_in([s]).cast("double")).over(behind).alias(f"s{k}") for k, s in enumerate(states)]
    each = seq.base.select("id", *shares).groupBy("id").agg(*(F.avg(f"s{k}").alias(f"s{k}") for k in range(len(states))))
    pairs = F.array(*(F.struct(F.lit(s).alias("state"), F.col(f"s{k}").alias("v")) for k, s in enumerate(states)))
    return each.select(F.explode(pairs).alias("x")).groupBy("x.state").agg(F.avg("x.v").alias("integration")).orderBy("state")
