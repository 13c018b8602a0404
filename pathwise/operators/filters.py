"""Sequence filters: each criterion is a set of ids, combined by semi and anti joins or set operations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SequenceCriterion:
    """A set of ids; subclasses give it as a DataFrame with one distinct column ``id``."""

    def ids(self, seq) -> DataFrame:
        raise NotImplementedError

    def filter(self, seq):
        return filter_sequences(seq, [self])


class _Flagged(SequenceCriterion):
    """A criterion that is one predicate over an aggregate of each sequence."""

    def measures(self, seq) -> dict[str, Column]:
        raise NotImplementedError

    def predicate(self) -> Column:
        raise NotImplementedError

    def ids(self, seq) -> DataFrame:
        return seq.base.groupBy("id").agg(*(c.alias(k) for k, c in self.measures(seq).items())).where(self.predicate()).select("id")


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


@dataclass
class LengthCriterion(_Flagged):
    min_length: int | None = None
    max_length: int | None = None
    exact_length: int | None = None

    def measures(self, seq):
        return {"n": F.count("*")}

    def predicate(self):
        n = F.col("n")
        if self.exact_length is not None:
            return n == self.exact_length
        return _all([n >= self.min_length] * (self.min_length is not None) + [n <= self.max_length] * (self.max_length is not None))


@dataclass
class TimeCriterion(_Flagged):
    start_after: Any = None
    start_before: Any = None
    end_after: Any = None
    end_before: Any = None
    contains_time: Any = None

    def measures(self, seq):
        return {"a": F.min("time"), "b": F.max("time")}

    def predicate(self):
        a, b, parts = F.col("a"), F.col("b"), []
        if self.start_after is not None:
            parts.append(a > F.lit(self.start_after))
        if self.start_before is not None:
            parts.append(a < F.lit(self.start_before))
        if self.end_after is not None:
            parts.append(b > F.lit(self.end_after))
        if self.end_before is not None:
            parts.append(b < F.lit(self.end_before))
        if self.contains_time is not None:
            parts += [a <= F.lit(self.contains_time), b >= F.lit(self.contains_time)]
        return _all(parts)


@dataclass
class ContainsStateCriterion(_Flagged):
    states: Sequence[str]
    require_all: bool = False
    exclude: bool = False

    def measures(self, seq):
        wanted = sorted(set(self.states))
        return {f"has{k}": F.coalesce(F.bool_or(F.col("state") == s), F.lit(False)) for k, s in enumerate(wanted)} or {"none": F.count("*")}

    def predicate(self):
        flags = [F.col(f"has{k}") for k in range(len(set(self.states)))]
        found = F.lit(self.require_all)
        for f in flags:
            found = (found & f) if self.require_all else (found | f)
        return ~found if self.exclude else found


@dataclass
class StartsWithCriterion(SequenceCriterion):
    """The first non-null states are the given ones; an empty prefix matches every sequence."""

    states: Sequence[str]

    def ids(self, seq) -> DataFrame:
        if not self.states:
            return seq.base.select("id").distinct()
        first = F.slice(F.filter("states", lambda s: s.isNotNull()), 1, len(self.states))
        return seq.sequences.where(first == F.array(*map(F.lit, self.states))).select("id")


@dataclass
class QueryCriterion(SequenceCriterion):
    """Sequences with any row, under its own column names, that satisfies a Column or SQL predicate."""

    expression: Column | str

    def ids(self, seq) -> DataFrame:
        return seq.data.where(self.expression).select(F.col(f"`{seq.config.id_column}`").alias("id")).distinct()


def filter_sequences(seq, criteria: Sequence[SequenceCriterion], combine: str = "and"):
    """All rows of the sequences that meet every (and) or some (or) criterion; no criterion: all, or none."""
    if combine not in ("and", "or"):
        raise ValueError(f"combine must be 'and' or 'or', not {combine!r}")
    key, data = seq.config.id_column, seq.data
    if not criteria:
        return seq._like(data if combine == "and" else data.where(F.lit(False)), seq._alphabet)
    sets = [c.ids(seq).withColumnRenamed("id", key) for c in criteria]
    if combine == "or":
        merged = sets[0]
        for s in sets[1:]:
            merged = merged.union(s)
        sets = [merged]
    for s in sets:
        data = data.join(s, key, "left_semi")
    return seq._like(data, seq._alphabet)
