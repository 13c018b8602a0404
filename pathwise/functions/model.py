"""Column mapping, alphabet and the two facades over a long table of (id, time, state).

Everything is lazy. Where an operator needs an order inside a sequence it sorts by time, then by state,
so rows of one time have a defined order. Null states are kept as rows and are in no inferred alphabet.
"""

from __future__ import annotations

import colorsys
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PALETTE_SIZE = 17
#: An alphabet lives on the driver and in plans; a column of more distinct values is refused.
MAX_STATES = 100_000
_UNITS = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK", "mo": "MONTH", "q": "QUARTER", "y": "YEAR"}
_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


@dataclass(frozen=True)
class SequenceConfig:
    id_column: str = "id"
    time_column: str = "time"
    state_column: str = "state"
    granularity: str | None = None

    @property
    def columns(self) -> tuple[str, str, str]:
        return self.id_column, self.time_column, self.state_column


def _palette(n: int) -> list[str]:
    """n colours, evenly spaced hues that repeat after PALETTE_SIZE."""
    out = []
    for k in range(n):
        r, g, b = colorsys.hls_to_rgb((k % PALETTE_SIZE) / PALETTE_SIZE, 0.5, 0.65)
        out.append(f"#{round(r * 255):02x}{round(g * 255):02x}{round(b * 255):02x}")
    return out


@dataclass(frozen=True)
class Alphabet:
    """Sorted distinct states with a colour each, given in their order or by name. Small by nature: it lives on the driver."""

    states: tuple[str, ...]
    colors: tuple[str, ...] | Mapping[str, str] | None = None
    _place: dict = field(init=False, repr=False, compare=False, hash=False, default_factory=dict)

    def __post_init__(self) -> None:
        states = tuple(sorted(set(self.states)))
        colors, palette = self.colors, _palette(len(states))
        if isinstance(colors, Mapping):  # states that it lacks keep the palette's colour
            colors = [colors.get(s, c) for s, c in zip(states, palette, strict=True)]
        colors = tuple(palette if colors is None else colors)
        if len(colors) < len(states):
            raise ValueError(f"{len(states)} states need as many colors, not {len(colors)}")
        object.__setattr__(self, "states", states)
        object.__setattr__(self, "colors", colors)
        self._place.update({s: i for i, s in enumerate(states)})

    def __len__(self) -> int:
        return len(self.states)

    def __iter__(self) -> Iterator[str]:
        return iter(self.states)

    def __contains__(self, state: object) -> bool:
        return state in self._place

    def index_of(self, state: str) -> int:
        if state not in self._place:
            raise ValueError(f"State {state!r} not in alphabet")
        return self._place[state]

    def get_color(self, state: str) -> str:
        return self.colors[self._place[state]]

    def __getitem__(self, place: int) -> str:
        return self.states[place]

    @property
    def n_states(self) -> int:
        return len(self.states)

    def with_colors(self, colors: Sequence[str] | Mapping[str, str]) -> Alphabet:
        """New colours: one for each state, or those of some states by name."""
        if isinstance(colors, Mapping):
            colors = [colors.get(s, c) for s, c in zip(self.states, self.colors, strict=False)]
        return Alphabet(self.states, tuple(colors))

    def encode(self, states: Iterable[str]) -> list[int]:
        return [self._place[s] for s in states]

    def decode(self, codes: Iterable[int]) -> list[str]:
        return [self.states[int(c)] for c in codes]

    @classmethod
    def from_sequence(cls, states: Iterable[str | None]) -> Alphabet:
        return cls(tuple(str(s) for s in states if s is not None))

    @classmethod
    def from_column(cls, df: DataFrame, column: str) -> Alphabet:
        """The distinct values of a column, at most MAX_STATES."""
        rows = df.select(F.col(f"`{column}`").cast("string").alias("s")).where("s is not null").distinct().limit(MAX_STATES + 1).collect()
        if len(rows) > MAX_STATES:
            raise ValueError(f"{column} has more than {MAX_STATES} values; it does not look like a state")
        return cls(tuple(r.s for r in rows))

    def code(self, state: Column) -> Column:
        """The int code of a state; null for a state that is not here."""
        places = F.array_position(F.array(*map(F.lit, self.states)), state) if self.states else F.lit(0)
        return F.nullif(places, F.lit(0)).cast("int") - 1

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(s, i) for i, s in enumerate(self.states)], "state string, code int")


def truncate(time: Column, granularity: str) -> Column:
    """Time floored to a unit such as 1d, 15m, 1mo; weeks start on Monday."""
    m = re.fullmatch(r"(\d+)(mo|[smhdwqy])", granularity)
    if not m:
        raise ValueError(f"Unknown granularity: {granularity!r}")
    n, unit = int(m[1]), m[2]
    if n == 1:
        return F.date_trunc(_UNITS[unit], time)
    if unit in _SECONDS:
        size = n * _SECONDS[unit]
        # Weeks count from a Monday, like a single week does.
        shift = 4 * 86400 if unit == "w" else 0
        seconds = F.unix_seconds(time.cast("timestamp")) - shift
        return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(size)) + shift)
    months = {"mo": 1, "q": 3, "y": 12}[unit] * n
    since = (F.year(time) - 1970) * 12 + F.month(time) - 1
    return F.add_months(F.to_date(F.lit("1970-01-01")), (since - F.pmod(since, F.lit(months))).cast("int")).cast("timestamp")


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


class _Container:
    """What both facades share: the long table, its mapping and its alphabet."""

    def __init__(self, df: DataFrame, config: SequenceConfig | None = None, alphabet: Alphabet | None = None) -> None:
        self.config = config or SequenceConfig()
        for c in self.config.columns:
            if c not in df.columns:
                raise ValueError(f"Missing required column: {c}")
        self.data = df
        self._alphabet = alphabet

    @property
    def spark(self):
        return self.data.sparkSession

    @property
    def alphabet(self) -> Alphabet:
        if self._alphabet is None:
            self._alphabet = Alphabet.from_column(self.data, self.config.state_column)
        return self._alphabet

    @property
    def base(self) -> DataFrame:
        """(id, time, state) under these names; all that statistics read, so the scan is pruned to it."""
        i, t, s = self.config.columns
        return self.data.select(F.col(f"`{i}`").alias("id"), F.col(f"`{t}`").alias("time"), F.col(f"`{s}`").cast("string").alias("state"))

    @property
    def window(self):
        return Window.partitionBy("id").orderBy("time", "state")

    @property
    def sequences(self) -> DataFrame:
        """(id, states, codes, n): a row for each sequence, states in order."""
        rows = self.base.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("time", F.struct(F.col("state").isNotNull().alias("k"), "state").alias("v")))).alias("r"))
        states = F.transform("r", lambda x: x["v"]["state"])
        return rows.select("id", states.alias("states"), F.transform(states, self.alphabet.code).alias("codes"), F.size("r").alias("n"))

    @property
    def sequence_ids(self) -> list:
        return [r.id for r in self.base.select("id").distinct().orderBy("id").collect()]

    def n_sequences(self) -> int:
        return self.base.select("id").distinct().count()

    def named(self, df: DataFrame) -> DataFrame:
        """``df`` with the id column under its configured name."""
        return df.withColumnRenamed("id", self.config.id_column)

    @classmethod
    def coerce(cls, data: _Container | DataFrame, config: SequenceConfig | None = None):
        """``data`` itself if it is of this kind, else the same rows in it."""
        return coerce(data, cls, config)

    def _like(self, df: DataFrame, alphabet: Alphabet | None = None):
        return type(self)(df, self.config, alphabet)


class SequencePool(_Container):
    """The analysis container. ``len`` is the number of sequences."""

    def __len__(self) -> int:
        return self.n_sequences()

    def __iter__(self) -> Iterator:
        """The ids in order, fetched a partition at a time."""
        return (r.id for r in self.base.select("id").distinct().orderBy("id").toLocalIterator())

    def __getitem__(self, key: Any) -> list[str | None]:
        return self.get_sequence(key)

    def get_sequence(self, key: Any) -> list[str | None]:
        rows = self.base.where(F.col("id") == F.lit(key)).orderBy("time", "state").select("state").collect()
        if not rows:
            raise KeyError(key)
        return [r.state for r in rows]

    def get_encoded_sequence(self, key: Any) -> list[int]:
        return self.alphabet.encode(self.get_sequence(key))

    def to_state_sequence(self) -> StateSequence:
        return StateSequence(self.data, self.config, self._alphabet)

    def sequence_lengths(self) -> DataFrame:
        return self.named(self.base.groupBy("id").agg(F.count("*").alias("length")))

    def describe(self) -> dict:
        lengths = self.base.groupBy("id").agg(F.count("*").alias("n"))
        r = lengths.agg(F.count("*").alias("c"), F.sum("n").alias("t"), F.min("n").alias("a"), F.max("n").alias("b"), F.avg("n").alias("m"), F.median("n").alias("d")).first()
        return {
            "n_sequences": r.c,
            "n_states": len(self.alphabet),
            "states": list(self.alphabet),
            "total_observations": r.t or 0,
            "min_length": r.a or 0,
            "max_length": r.b or 0,
            "mean_length": r.m or 0,
            "median_length": r.d or 0,
        }

    def filter_by_length(self, min_length: int | None = None, max_length: int | None = None) -> SequencePool:
        from pathwise.operators.filters import LengthCriterion, filter_sequences

        return self._like(filter_sequences(self, [LengthCriterion(min_length, max_length)]).data, self._alphabet)

    def sample(self, n: int, seed: int | None = None) -> SequencePool:
        """min(n, all) whole sequences drawn without replacement; the same seed draws the same ids."""
        ids = drawn_ids(self.base.select("id").distinct(), n, seed)
        key = self.config.id_column
        return self._like(self.data.join(ids.withColumnRenamed("id", key), key, "left_semi"), self._alphabet)

    def recode_states(self, mapping: Mapping[str, str]) -> SequencePool:
        """States renamed or merged; what the mapping lacks stays. The alphabet is inferred anew."""
        s = self.config.state_column
        if not mapping:
            return self._like(self.data)
        table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
        old = F.col(f"`{s}`").cast("string")
        return self._like(self.data.withColumn(s, F.coalesce(F.try_element_at(table, old), old)))

    def compute_distances(self, method: str = "om", **options):
        from pathwise.operators.distances import compute

        return compute(self, method, **options)


class StateSequence(_Container):
    """The representation view. ``len`` is the number of rows; granularity is applied here."""

    def __init__(self, df: DataFrame, config: SequenceConfig | None = None, alphabet: Alphabet | None = None) -> None:
        super().__init__(df, config, alphabet)
        if self.config.granularity:
            t = self.config.time_column
            if not is_temporal(self.data.schema[t].dataType):
                raise ValueError("granularity requires a temporal time column")
            self.data = self.data.withColumn(t, truncate(F.col(f"`{t}`"), self.config.granularity))
        if alphabet is not None and (extra := [r[0] for r in uncovered(self.data, self.config, alphabet).limit(10).collect()]):
            raise ValueError(f"States not in alphabet: {extra}")

    def __len__(self) -> int:
        return self.data.count()

    def to_pool(self) -> SequencePool:
        return SequencePool(self.data, self.config, self._alphabet)

    def to_sts(self) -> DataFrame:
        return self.data

    def get_sequence(self, key: Any) -> DataFrame:
        i, t, _ = self.config.columns
        return self.data.where(F.col(f"`{i}`") == F.lit(key)).orderBy(t)

    def get_states_for_sequence(self, key: Any) -> list[str | None]:
        return [r.state for r in self.base.where(F.col("id") == F.lit(key)).orderBy("time", "state").collect()]

    def to_sps(self, global_ids: bool = True) -> DataFrame:
        from pathwise.operators import spells

        return spells.to_sps(self, global_ids)

    def to_dss(self) -> DataFrame:
        from pathwise.operators import spells

        return spells.to_dss(self)

    def state_counts(self) -> DataFrame:
        from pathwise.operators import spells

        return spells.state_counts(self)

    def state_per_sequence(self, proportion: bool = False) -> DataFrame:
        from pathwise.operators import spells

        return spells.state_per_sequence(self, proportion)

    def duration(self) -> DataFrame:
        from pathwise.operators import spells

        return spells.durations(self)

    def total_duration_by_state(self) -> DataFrame:
        from pathwise.operators import spells

        return spells.total_duration_by_state(self)

    def spells_per_sequence(self) -> DataFrame:
        from pathwise.operators import spells

        return spells.spells_per_sequence(self)

    def span(self) -> DataFrame:
        from pathwise.operators import spells

        return spells.span(self)

    @classmethod
    def from_intervals(cls, df: DataFrame, **options) -> StateSequence:
        from pathwise.sources.intervals import sample_intervals

        return sample_intervals(df, **options)


def drawn_ids(ids: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n rows of ``ids`` (id, distinct): those of the least MD5 of seed and id, or random ones without a seed."""
    order = F.rand() if seed is None else F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    return ids.orderBy(order, "id").limit(n)


def uncovered(df: DataFrame, config: SequenceConfig, alphabet: Alphabet) -> DataFrame:
    s = F.col(f"`{config.state_column}`").cast("string")
    return df.where(s.isNotNull() & ~s.isin(*alphabet.states)).select(s.alias("state")).distinct()


def coerce(data: _Container | DataFrame, kind: type = SequencePool, config: SequenceConfig | None = None) -> Any:
    """``data`` itself if it is of the kind, else the same rows, mapping and alphabet in that facade."""
    if isinstance(data, kind):
        return data
    if isinstance(data, _Container):
        return kind(data.data, data.config, data._alphabet)
    return kind(data, config)
