"""Synthetic sequences. Every sequence draws from a generator seeded by (seed, id), so results do not
depend on partitions and a lost task gives the same rows again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import astuple, dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwise.functions.model import Alphabet, SequencePool

# The states of a customer journey, by category.
ONBOARDING_STATES = ["lead", "application_started", "kyc_pending", "kyc_approved", "kyc_rejected", "account_opened"]
ACTIVITY_STATES = ["dormant", "low_activity", "medium_activity", "high_activity"]
PRODUCT_STATES = [
    "checking_only", "savings_added", "credit_card_applied", "credit_card_approved", "credit_card_rejected", "loan_applied",
    "loan_approved", "loan_rejected", "mortgage_inquiry", "mortgage_approved", "investment_opened",
]
RISK_STATES = ["good_standing", "missed_payment", "delinquent_30", "delinquent_60", "delinquent_90", "collections", "closed_voluntary", "closed_involuntary"]
ENGAGEMENT_STATES = ["app_download", "online_banking_active", "mobile_deposit_used", "direct_deposit_setup", "autopay_enabled", "rewards_enrolled"]
ALL_STATES = ONBOARDING_STATES + ACTIVITY_STATES + PRODUCT_STATES + RISK_STATES + ENGAGEMENT_STATES
CATEGORIES = {
    s: name
    for name, group in (("onboarding", ONBOARDING_STATES), ("activity", ACTIVITY_STATES), ("product", PRODUCT_STATES), ("risk", RISK_STATES), ("engagement", ENGAGEMENT_STATES))
    for s in group
}


@dataclass
class TransitionConfig:
    """Yearly and conditional rates. Fixed values."""

    kyc_approval_rate: float = 0.85
    account_open_rate: float = 0.90
    savings_adoption_rate: float = 0.40
    credit_card_apply_rate: float = 0.30
    credit_card_approval_rate: float = 0.75
    loan_apply_rate: float = 0.15
    loan_approval_rate: float = 0.60
    mortgage_inquiry_rate: float = 0.08
    mortgage_approval_rate: float = 0.50
    investment_adoption_rate: float = 0.12
    dormant_rate: float = 0.15
    low_activity_rate: float = 0.30
    medium_activity_rate: float = 0.35
    high_activity_rate: float = 0.20
    missed_payment_rate: float = 0.08
    delinquency_progression_rate: float = 0.40
    recovery_rate: float = 0.60
    collections_rate: float = 0.15
    voluntary_churn_rate: float = 0.05
    involuntary_churn_rate: float = 0.02
    app_download_rate: float = 0.60
    online_banking_rate: float = 0.50
    mobile_deposit_rate: float = 0.25
    direct_deposit_rate: float = 0.40
    autopay_rate: float = 0.35
    rewards_rate: float = 0.20


@dataclass
class SeasonalConfig:
    """Multipliers of a season. ``new_year_signup_boost`` is part of the format and has no effect."""

    tax_season_loan_boost: float = 1.5
    holiday_cc_boost: float = 1.3
    new_year_signup_boost: float = 1.4
    summer_activity_reduction: float = 0.9


@dataclass
class JourneyConfig:
    transitions: TransitionConfig = field(default_factory=TransitionConfig)
    seasonal: SeasonalConfig = field(default_factory=SeasonalConfig)
    min_observations_per_year: int = 12
    max_observations_per_year: int = 365
    time_slots_per_day: int = 1


_LADDER = ["missed_payment", "delinquent_30", "delinquent_60", "delinquent_90"]
_WAITING = ((0, "lead"), (2, "application_started"), (5, "kyc_pending"))


class _Customer:
    """One journey: an automaton whose phase is a method that yields the next state."""

    def __init__(self, rng: np.random.Generator, config: JourneyConfig) -> None:
        self.rng, self.t, self.season = rng, config.transitions, config.seasonal
        self.phase, self.owned, self.arrears = self.onboarding, set(), 0

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def close(self, state: str) -> str:
        self.phase = None
        return state

    def onboarding(self, age: int, month: int) -> str:
        for limit, state in _WAITING:
            if age <= limit:
                return state
        if age <= 7:
            return "kyc_approved" if self.chance(self.t.kyc_approval_rate) else self.close("kyc_rejected")
        if not self.chance(self.t.account_open_rate):
            return "kyc_approved"
        self.phase = self.active
        return "account_opened"

    def late(self, age: int, month: int) -> str:
        if self.chance(self.t.recovery_rate):
            self.phase = self.active
            return "good_standing"
        last = self.arrears == len(_LADDER) - 1
        if not last:
            self.arrears += self.chance(self.t.delinquency_progression_rate)
        elif self.chance(self.t.collections_rate):
            return self.close("closed_involuntary") if self.chance(3 * self.t.involuntary_churn_rate) else "collections"
        return _LADDER[self.arrears]

    def offer(self, product: str, p: float, asked: str, granted: str, refused: str, approval: float) -> str | None:
        """The outcome of an application, or None if there is none."""
        if product in self.owned or not self.chance(p):
            return None
        if not self.chance(approval):
            return refused
        self.owned.add(product)
        return granted

    def active(self, age: int, month: int) -> str:
        t, s = self.t, self.season
        if self.chance(t.voluntary_churn_rate / 12):
            return self.close("closed_voluntary")
        if self.chance(t.missed_payment_rate / 12):
            self.phase, self.arrears = self.late, 0
            return _LADDER[0]
        if got := self.offer("savings", t.savings_adoption_rate / 12, "", "savings_added", "", 1.0):
            return got
        # Until a card is held no further product is offered, and then none until a loan is.
        card = t.credit_card_apply_rate / 12 * (s.holiday_cc_boost if month in (11, 12) else 1)
        loan = t.loan_apply_rate / 12 * (s.tax_season_loan_boost if month in (3, 4) else 1)
        for product, p, names, approval in (
            ("card", card, ("credit_card_applied", "credit_card_approved", "credit_card_rejected"), t.credit_card_approval_rate),
            ("loan", loan, ("loan_applied", "loan_approved", "loan_rejected"), t.loan_approval_rate),
        ):
            if product not in self.owned:
                return self.offer(product, p, *names, approval) or self.activity(month)
        got = self.offer("mortgage", t.mortgage_inquiry_rate / 24, "", "mortgage_approved", "mortgage_inquiry", t.mortgage_approval_rate)
        got = got or self.offer("investment", t.investment_adoption_rate / 12, "", "investment_opened", "", 1.0)
        return got or (self.engagement() if self.chance(0.1) else self.activity(month))

    def activity(self, month: int) -> str:
        t = self.t
        shares = [t.dormant_rate, t.low_activity_rate, t.medium_activity_rate * (self.season.summer_activity_reduction if month in (6, 7, 8) else 1)]
        return ACTIVITY_STATES[int(np.searchsorted(np.cumsum(shares), self.rng.random(), side="right"))]

    def engagement(self) -> str:
        rates = np.array(astuple(self.t)[-len(ENGAGEMENT_STATES) :])
        return ENGAGEMENT_STATES[int(self.rng.choice(len(rates), p=rates / rates.sum()))]


def _journey(key: int, seed: int, config: JourneyConfig) -> Iterator[tuple[int, str]]:
    rng = np.random.default_rng([seed, key])
    slots = 365 * config.time_slots_per_day
    n = min(slots, int(rng.integers(config.min_observations_per_year, config.max_observations_per_year + 1)))
    times = np.sort(rng.choice(slots, n, replace=False)).tolist()
    customer = _Customer(rng, config)
    first = times[0] // config.time_slots_per_day if times else 0
    for t in times:
        if customer.phase is None:
            return
        day = t // config.time_slots_per_day
        yield t, customer.phase(day - first, day // 30 + 1)


def generate_financial_journeys(spark: SparkSession, n_users: int = 100_000, year: int = 2025, seed: int | None = None, config: JourneyConfig | None = None) -> DataFrame:
    """id, time, state, state_category, date of simulated customer journeys over a year."""
    config, seed = config or JourneyConfig(), 0 if seed is None else seed
    assert len(fields(TransitionConfig)) == 26

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t, s) for i in b.column(0).to_pylist() for t, s in _journey(i, seed, config)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))] + [pa.array([CATEGORIES[r[2]] for r in rows], pa.string())], ["id", "time", "state", "state_category"])

    out = spark.range(n_users).mapInArrow(run, "id long, time long, state string, state_category string")
    day = F.floor(F.col("time") / config.time_slots_per_day).cast("int")
    return out.withColumn("date", F.date_add(F.to_date(F.lit(f"{year}-01-01")), day))


def _uniform(seed: int, *place: Column | str) -> Column:
    """A number in 0..2**52 - 1 by the MD5 of seed and place: a draw that any engine can repeat."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c) if isinstance(c, str) else c for c in place)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def markov_matrix(seed: int, n_states: int = 4) -> np.ndarray:
    """Rows drawn from the uniform distribution over all distributions."""
    return np.random.default_rng(seed).dirichlet(np.ones(n_states), n_states)


def generate_markov_sequences(
    spark: SparkSession, n_sequences: int = 1000, sequence_length: int = 20, transition_matrix: np.ndarray | None = None, states: Sequence[str] | None = None, seed: int | None = None
) -> SequencePool:
    """A uniform first state, then steps of a Markov chain, in built-in functions; the default matrix has Dirichlet(1) rows."""
    seed = 0 if seed is None else seed
    p = markov_matrix(seed) if transition_matrix is None else np.asarray(transition_matrix, float)
    names = [chr(65 + k) for k in range(len(p))] if states is None else list(states)
    if p.shape != (len(names),) * 2:
        raise ValueError("the transition matrix must have a row and a column for each state")
    # The next state is the number of cumulated probabilities, but the last, that do not exceed the draw.
    limits = F.array(*(F.array(*(F.lit(float(x)) for x in row[:-1])).cast("array<double>") for row in np.cumsum(p, axis=1)))
    share = lambda t: _uniform(seed, F.col("id").cast("string"), t.cast("string")) / F.lit(float(1 << 52))

    def step(path: Column, t: Column) -> Column:
        now = F.get(limits, F.get(path, t - 1))
        return F.concat(path, F.array(F.size(F.filter(now, lambda x: x <= share(t))).cast("int")))

    first = F.array(F.floor(share(F.lit(0)) * len(names)).cast("int"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(sequence_length - 1)), first, step) if sequence_length > 1 else first
    rows = spark.range(n_sequences if sequence_length > 0 else 0).select("id", F.posexplode(path).alias("time", "code"))
    state = F.get(F.array(*map(F.lit, names)), F.col("code"))
    return SequencePool(rows.select("id", F.col("time").cast("long").alias("time"), state.alias("state")), alphabet=Alphabet(tuple(names)))


def generate_simple_sequences(spark: SparkSession, n_sequences: int = 1000, sequence_length: int = 10, n_states: int = 4, seed: int | None = None) -> SequencePool:
    """Independent uniform states, from built-in functions alone."""
    names = [chr(65 + k) for k in range(n_states)]
    rows = spark.range(n_sequences).withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(sequence_length - 1)).cast("array<bigint>")))
    draw = (_uniform(0 if seed is None else seed, F.col("id").cast("string"), F.col("time").cast("string")) % n_states).cast("int")
    return SequencePool(rows.withColumn("state", F.get(F.array(*map(F.lit, names)), draw)), alphabet=Alphabet(tuple(names)))
