"""Descriptive statistics of sequences.

A statistic of a sequence is an aggregate of one windowed pass, so any number of them shares one exchange
and one sort (``describe_sequences``). With ``per_sequence`` an operator gives (id, value), otherwise the
mean (a sum for transition counts), as a float; NaN for no sequences.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwise.functions.model import is_temporal, truncate
from pathwise.operators.spells import marked, spells


def reduced(seq, rows: DataFrame, name: str, per_sequence: bool, how: str = "mean"):
    """(id, name) of ``rows``, or one number over them."""
    if per_sequence:
        return seq.named(rows.select("id", name))
    value = rows.agg((F.avg if how == "mean" else F.sum)(name)).first()[0]
    if value is None:
        return math.nan if how == "mean" else 0
    return float(value) if how == "mean" else value


def _ratio(top: Column, bottom: Column, least: int = 1) -> Column:
    """top / bottom, 0 where bottom is below ``least``."""
    return F.when(bottom >= least, top / F.greatest(bottom, F.lit(least))).otherwise(0.0)


def _passes(seq) -> DataFrame:
    """(id, n, changes, visited) of each sequence from one windowed pass."""
    rows = seq.base.withColumn("prev", F.lag(F.struct("state")).over(seq.window))
    moved = F.col("prev").isNotNull() & ~F.col("prev.state").eqNullSafe(F.col("state"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(moved.cast("long")).alias("changes"), (F.count_distinct("state") + F.max(F.col("state").isNull().cast("int"))).alias("visited"))


def measures(seq, names: Sequence[str]) -> DataFrame:
    """(id, *names) for the simple measures, one shared pass."""
    n, changes, visited, k = F.col("n"), F.col("changes"), F.col("visited"), max(1, len(seq.alphabet)) if "visited_proportion" in names else 1
    known = {
        "n_transitions": changes,
        "length": n,
        "n_spells": changes + 1,
        "n_visited": visited,
        "complexity": F.when(n > 1, F.sqrt(changes * visited) / n).otherwise(0.0),
        "visited_proportion": visited / F.lit(float(k)),
        "transition_proportion": _ratio(changes.cast("double"), n - 1),
    }
    return _passes(seq).select("id", *(known[x].alias(x) for x in names))


def describe_sequences(seq, names: Sequence[str] = ("length", "n_spells", "n_visited", "n_transitions", "complexity", "visited_proportion", "transition_proportion")) -> DataFrame:
    return seq.named(measures(seq, names))


def transition_count(seq, per_sequence: bool = False):
    return reduced(seq, measures(seq, ["n_transitions"]), "n_transitions", per_sequence, "sum")


def sequence_length(seq, per_sequence: bool = False):
    return reduced(seq, measures(seq, ["length"]), "length", per_sequence)


def complexity_index(seq, per_sequence: bool = False):
    """sqrt(transitions * visited states) / length."""
    return reduced(seq, measures(seq, ["complexity"]), "complexity", per_sequence)


def spell_count(seq, per_sequence: bool = False):
    return reduced(seq, measures(seq, ["n_spells"]), "n_spells", per_sequence)


def visited_states(seq, per_sequence: bool = False):
    return reduced(seq, measures(seq, ["n_visited"]), "n_visited", per_sequence)


def visited_proportion(seq, per_sequence: bool = False):
    return reduced(seq, measures(seq, ["visited_proportion"]), "visited_proportion", per_sequence)


def transition_proportion(seq, per_sequence: bool = False):
    return reduced(seq, measures(seq, ["transition_proportion"]), "transition_proportion", per_sequence)


def longitudinal_entropy(seq, normalize: bool = True, per_sequence: bool = False):
    """Entropy of a sequence's state shares, over that of a uniform alphabet if normalised."""
    shares = seq.base.groupBy("id", "state").agg(F.count("*").alias("c"))
    # -sum(c / n * ln(c / n)) from two sums: no second pass over the counts.
    n, cl = F.sum("c"), F.sum(F.col("c") * F.ln("c"))
    value = F.greatest(F.ln(n) - cl / n, F.lit(0.0))
    if normalize and len(seq.alphabet) > 1:
        value = value / math.log(len(seq.alphabet))
    return reduced(seq, shares.groupBy("id").agg(value.alias("entropy")), "entropy", per_sequence)


def _turbulence(seq) -> DataFrame:
    stats = spells(seq).groupBy("id").agg(F.count("*").alias("k"), F.var_pop("duration").alias("v"), F.avg("duration").alias("m"), F.sum("duration").alias("n"))
    value = F.when(F.col("k") > 1, F.greatest(F.lit(0.0), F.log2(F.col("k") * (F.col("v") + 1) / F.col("m")))).otherwise(0.0)
    return stats.select("id", "n", value.alias("turbulence"))


def turbulence(seq, per_sequence: bool = False):
    return reduced(seq, _turbulence(seq), "turbulence", per_sequence)


def normalized_turbulence(seq, per_sequence: bool = False):
    value = F.when(F.col("n") > 1, F.col("turbulence") / F.log2(F.greatest("n", F.lit(2)))).otherwise(0.0)
    return reduced(seq, _turbulence(seq).select("id", value.alias("normalized_turbulence")), "normalized_turbulence", per_sequence)


def state_distribution(seq, time_point=None, per_sequence: bool = False) -> DataFrame:
    rows = seq.base if time_point is None else seq.base.where(F.col("time") == F.lit(time_point))
    keys = ["id", "state"] if per_sequence else ["state"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("count"))
    # Without a key the window holds a row for each state of the alphabet.
    total = F.sum("count").over(Window.partitionBy("id") if per_sequence else Window.partitionBy(F.lit(0)))
    out = counts.withColumn("proportion", F.col("count") / total)
    return seq.named(out) if per_sequence else out.orderBy(F.desc("count"), "state")


def mean_time_in_state(seq, per_sequence: bool = False) -> DataFrame:
    if per_sequence:
        return seq.named(seq.base.groupBy("id", "state").agg(F.count("*").alias("time_in_state")))
    ids = F.broadcast(seq.base.agg(F.count_distinct("id").alias("_n")))  # one row
    totals = seq.base.groupBy("state").agg(F.count("*").alias("total_time"))
    return totals.crossJoin(ids).select("state", "total_time", (F.col("total_time") / F.col("_n")).alias("mean_time")).orderBy("state")


def modal_states(seq, granularity: str | None = None) -> DataFrame:
    """time, modal_state, frequency, proportion; every state that ties for the mode of a time."""
    rows = seq.base
    if granularity is not None:
        if not isinstance(granularity, str):
            raise TypeError("granularity must be a string")
        if not is_temporal(rows.schema["time"].dataType):
            raise ValueError("granularity requires a temporal time column")
        rows = rows.withColumn("time", truncate(F.col("time"), granularity))
    counts = rows.groupBy("time", "state").agg(F.count("*").alias("frequency"))
    w = Window.partitionBy("time")
    ranked = counts.withColumn("r", F.rank().over(w.orderBy(F.desc("frequency")))).withColumn("proportion", F.col("frequency") / F.sum("frequency").over(w))
    return ranked.where("r = 1").select(F.col("time").alias(seq.config.time_column), F.col("state").alias("modal_state"), "frequency", "proportion").orderBy(seq.config.time_column, "modal_state")


def sequence_frequency_table(seq, n_top: int | None = None) -> DataFrame:
    patterns = seq.sequences.select(F.array_join("states", "-").alias("sequence")).groupBy("sequence").agg(F.count("*").alias("count"))
    n = F.broadcast(seq.base.agg(F.count_distinct("id").alias("_n")))
    out = patterns.crossJoin(n).select("sequence", "count", (F.col("count") / F.col("_n")).alias("proportion")).orderBy(F.desc("count"), "sequence")
    return out if n_top is None else out.limit(n_top)


def subsequence_count(seq, states_filter: Sequence[str] | None = None, use_log: bool = False, per_sequence: bool = False):
    """Distinct non-empty subsequences of each sequence, exact to 38 digits; their log2 with ``use_log``.

    The exact form overflows to an error above about 125 distinct steps; use the log there.
    """
    rows = seq.sequences.select("id", "states")
    if states_filter is not None:
        rows = rows.select("id", F.filter("states", lambda s: s.isin(*states_filter)).alias("states"))
    kind = "double" if use_log else "decimal(38,0)"
    # last: for each state, the count before its latest use.
    start = F.struct(F.lit(0.0 if use_log else 1).cast(kind).alias("dp"), F.create_map().cast(f"map<string,{kind}>").alias("last"))

    def step(a, s):
        old, s = F.try_element_at(a["last"], F.coalesce(s, F.lit("\0"))), F.coalesce(s, F.lit("\0"))
        if use_log:
            gap = old - (a["dp"] + 1)
            grown = a["dp"] + 1 + F.when(gap > -50, F.log2(1 - F.pow(F.lit(2.0), gap))).otherwise(0.0)
            dp = F.coalesce(F.when(old.isNotNull(), grown), a["dp"] + 1)
        else:
            dp = (a["dp"] * 2 - F.coalesce(old, F.lit(0).cast(kind))).cast(kind)
        last = F.map_concat(F.map_filter(a["last"], lambda k, _: k != s), F.create_map(s, a["dp"]))
        return F.struct(dp.cast(kind).alias("dp"), last.cast(f"map<string,{kind}>").alias("last"))

    name = "log2_n_subsequences" if use_log else "n_subsequences"
    value = F.aggregate("states", start, step, lambda a: a["dp"] if use_log else (a["dp"] - 1).cast(kind))
    return reduced(seq, rows.select("id", value.alias(name)), name, per_sequence)


def sequence_log_probability(seq, per_sequence: bool = False):
    """Log probability of a sequence's transitions under the rates of the whole pool."""
    from pathwise.operators.transitions import steps

    moves = steps(seq)
    counts = moves.groupBy("from_state", "to_state").agg(F.count("*").alias("c"))
    rates = counts.withColumn("lp", F.ln(F.col("c") / F.sum("c").over(Window.partitionBy("from_state")))).select("from_state", "to_state", "lp")
    # A row for each pair of states: bounded by the square of the alphabet.
    scored = moves.join(F.broadcast(rates), ["from_state", "to_state"]).groupBy("id").agg(F.sum("lp").alias("s"))
    out = seq.base.select("id").distinct().join(scored, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("log_probability"))
    return reduced(seq, out, "log_probability", per_sequence)
