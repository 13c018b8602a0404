"""Transitions, spell lengths and substitution costs."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.operators.spells import spells

TINY = 1e-10


def steps(seq) -> DataFrame:
    """(id, from_state, to_state) of adjacent observations."""
    rows = seq.base.select("id", F.col("state").alias("from_state"), F.lead("state").over(seq.window).alias("to_state"))
    return rows.where("from_state is not null and to_state is not null")


def transition_rates(seq, exclude_self: bool = False) -> DataFrame:
    """from_state, to_state, count, rate for every pair of alphabet states."""
    states = seq.alphabet.frame(seq.spark).select("state")
    grid = states.select(F.col("state").alias("from_state")).crossJoin(states.select(F.col("state").alias("to_state")))
    counts = steps(seq).groupBy("from_state", "to_state").agg(F.count("*").alias("count"))
    if exclude_self:
        grid, counts = grid.where("from_state <> to_state"), counts.where("from_state <> to_state")
    full = grid.join(counts, ["from_state", "to_state"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = F.sum("count").over(Window.partitionBy("from_state"))
    return full.withColumn("rate", F.when(total > 0, F.col("count") / F.greatest(total, F.lit(1))).otherwise(0.0)).orderBy("from_state", "to_state")


def transition_rate_matrix(seq, as_counts: bool = False, exclude_self: bool = False) -> np.ndarray:
    """K x K in alphabet order; rows without transitions stay 0. K squared cells come to the driver."""
    out = np.zeros((len(seq.alphabet),) * 2)
    for r in steps(seq).groupBy("from_state", "to_state").agg(F.count("*").alias("n")).collect():
        out[seq.alphabet.index_of(r.from_state), seq.alphabet.index_of(r.to_state)] = r.n
    if exclude_self:
        np.fill_diagonal(out, 0)
    if as_counts:
        return out
    total = out.sum(1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 0)


def first_occurrence_time(seq, state: str) -> DataFrame:
    """id and its first time in a state; sequences that never reach it are absent."""
    return seq.named(seq.base.where(F.col("state") == state).groupBy("id").agg(F.min("time").alias("first_time")))


def state_spell_stats(seq) -> DataFrame:
    d = "duration"
    out = spells(seq).groupBy("state").agg(
        F.avg(d).alias("mean_duration"), F.median(d).alias("median_duration"), F.min(d).alias("min_duration"), F.max(d).alias("max_duration"), F.stddev_samp(d).alias("std_duration"), F.count("*").alias("n_spells")
    )
    return out.orderBy("state")


def state_duration_stats(seq) -> DataFrame:
    warnings.warn("state_duration_stats is deprecated; use state_spell_stats", DeprecationWarning, stacklevel=2)
    return state_spell_stats(seq)


def build_substitution_matrix(
    n_states: int,
    method: str = "constant",
    cost: float = 2.0,
    transition_rates: np.ndarray | None = None,
    state_frequencies: np.ndarray | None = None,
    features: np.ndarray | None = None,
) -> np.ndarray:
    """A symmetric cost table with a zero diagonal; K is small, so this is driver numpy."""

    def needed(x, what):
        if x is None:
            raise ValueError(f"{what} required for method {method!r}")
        return np.asarray(x, float)

    if method == "constant":
        out = np.full((n_states, n_states), float(cost))
    elif method == "trate":
        p = needed(transition_rates, "transition_rates")
        out = 2.0 - p - p.T
    elif method in ("indels", "indelslog"):
        f = needed(state_frequencies, "state_frequencies")
        own = 1.0 / np.where(f > 0, f, TINY)
        if method == "indelslog":
            own = np.log(own)
        out = own[:, None] + own[None, :]
    elif method == "future":
        p = needed(transition_rates, "transition_rates")
        a, b = p[:, None, :], p[None, :, :]
        total = a + b
        out = np.divide((a - b) ** 2, total, out=np.zeros_like(total), where=total > 0).sum(2)
    elif method == "features":
        x = needed(state_frequencies if features is None else features, "features")
        x = x[:, None] if x.ndim == 1 else x
        spread = np.ptp(x, axis=0)
        gaps = np.abs(x[:, None, :] - x[None, :, :])
        out = np.divide(gaps, spread, out=np.zeros_like(gaps), where=spread > 0).mean(2)
    else:
        raise ValueError(f"Unknown method: {method!r}")
    out = np.array(out, float)
    np.fill_diagonal(out, 0.0)
    return out


def substitution_cost_matrix(seq, method: str = "trate") -> np.ndarray:
    if method == "constant":
        return build_substitution_matrix(len(seq.alphabet))
    if method == "trate":
        return build_substitution_matrix(len(seq.alphabet), "trate", transition_rates=transition_rate_matrix(seq))
    raise ValueError(f"Unknown method: {method!r}")


def state_frequencies(seq) -> np.ndarray:
    """Share of each alphabet state among all observations."""
    got: Mapping[str, int] = {r.state: r.n for r in seq.base.groupBy("state").agg(F.count("*").alias("n")).collect()}
    n = np.array([got.get(s, 0) for s in seq.alphabet.states], float)
    return n / max(1.0, n.sum())


def costs_frame(seq, matrix: np.ndarray) -> DataFrame:
    """A cost table in long form: from_state, to_state, cost."""
    s = seq.alphabet.states
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(s) for j, b in enumerate(s)]
    return seq.spark.createDataFrame(rows, "from_state string, to_state string, cost double")
