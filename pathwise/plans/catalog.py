"""Queries over the standard tables, each with equivalent DuckDB SQL where SQL can express it.

Pools: ``events`` (a user's event types in time), ``orders`` (a customer's order priorities),
``conversations`` (the roles of a conversation's turns) and ``hours`` (a user's most frequent event type
in each hour of the day, sequences of one length). All run over whole tables.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwise.functions.model import Alphabet, SequenceConfig, SequencePool, StateSequence
from pathwise.functions.runtime import materialise, shared_dir
from pathwise.operators import clustering, descriptive, discrepancy, distances, filters, mining, normative, transitions
from pathwise.plans import oracles
from pathwise.sources import (
    generate_financial_journeys,
    generate_markov_sequences,
    generate_simple_sequences,
    load_csv,
    load_dataframe,
    load_json,
    load_parquet,
    sample_intervals,
    save_csv,
    save_json,
    save_parquet,
)

from pathwise.sources.synthetic import CATEGORIES, ONBOARDING_STATES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

POSITIVE, NEGATIVE = ("purchase", "signup"), ("error",)
EVENTS = SequenceConfig("user_id", "ts", "event_type")
ORDERS = SequenceConfig("o_custkey", "o_orderdate", "o_orderpriority")
TALKS = SequenceConfig("conv_id", "turn", "role")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str, kind: type = SequencePool):
    return kind(table(spark, d, "events"), EVENTS)


def orders(spark: SparkSession, d: str) -> SequencePool:
    return SequencePool(table(spark, d, "orders"), ORDERS)


def talks(spark: SparkSession, d: str) -> SequencePool:
    return SequencePool(table(spark, d, "conversations"), TALKS)


def hours(spark: SparkSession, d: str) -> SequencePool:
    """24 steps for each user: the hour's most frequent event type (the least of ties), or none; written, as a pool is read several times."""
    rows = table(spark, d, "events").where("user_id is not null").select(F.col("user_id").alias("id"), F.hour("ts").cast("long").alias("time"), F.col("event_type").alias("state"))
    counts = rows.groupBy("id", "time", "state").agg(F.count("*").alias("n"))
    mode = counts.groupBy("id", "time").agg(F.min(F.struct(-F.col("n"), "state"))["state"].alias("state"))
    grid = rows.select("id").distinct().withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(23)).cast("array<bigint>")))
    steps = grid.join(mode, ["id", "time"], "left").select("id", "time", F.coalesce("state", F.lit("none")).alias("state"))
    return SequencePool(materialise(steps))


def seconds(c: str) -> Column:
    """Whole seconds since 1970 of a time without zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)").cast("long")


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(name or c)


_E = "e AS (SELECT user_id AS id, ts AS time, event_type AS state FROM events)"
_O = "e AS (SELECT o_custkey AS id, o_orderdate AS time, o_orderpriority AS state FROM orders)"
_T = "e AS (SELECT conv_id AS id, turn AS time, role AS state FROM conversations)"
_SPELLS = """m AS (SELECT *, CASE WHEN state = lag(state) OVER w THEN 0 ELSE 1 END AS ch FROM e WINDOW w AS (PARTITION BY id ORDER BY time, state)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY id ORDER BY time, state ROWS UNBOUNDED PRECEDING) AS sp FROM m),
spells AS (SELECT id, sp, min(state) AS state, min(time) AS a, max(time) AS b, count(*) AS d FROM g GROUP BY id, sp)"""
_STEPS = "s AS (SELECT id, state AS f, lead(state) OVER (PARTITION BY id ORDER BY time, state) AS t FROM e)"
_SECS = "date_diff('second', TIMESTAMP '1970-01-01', {})"


# --- representation --------------------------------------------------------------------------------

register(
    "sps",
    f"WITH {_E}, {_SPELLS} SELECT id AS user_id, row_number() OVER (ORDER BY id, sp) AS spell_id, state, {_SECS.format('a')} AS start_s, {_SECS.format('b')} AS end_s, d AS duration FROM spells",
)(lambda s, d: events(s, d, StateSequence).to_sps().select("user_id", "spell_id", "state", seconds("start").alias("start_s"), seconds("end").alias("end_s"), "duration"))

register("dss", f"WITH {_E}, {_SPELLS} SELECT id AS user_id, {_SECS.format('a')} AS time_s, state AS event_type FROM spells")(
    lambda s, d: events(s, d, StateSequence).to_dss().select("user_id", seconds("ts").alias("time_s"), "event_type")
)

register("spells_per_sequence", f"WITH {_E}, {_SPELLS} SELECT id AS user_id, count(*) AS n_spells FROM spells GROUP BY id")(lambda s, d: events(s, d, StateSequence).spells_per_sequence())
register("spell_durations", f"WITH {_E}, {_SPELLS} SELECT id AS user_id, state, d AS duration FROM spells")(lambda s, d: events(s, d, StateSequence).duration())
register("total_duration_by_state", "SELECT event_type AS state, count(*) AS total_duration FROM events GROUP BY 1")(lambda s, d: events(s, d, StateSequence).total_duration_by_state())
register("span", f"SELECT user_id, {_SECS.format('min(ts)')} AS first_s, {_SECS.format('max(ts)')} AS last_s FROM events GROUP BY 1")(
    lambda s, d: events(s, d, StateSequence).span().select("user_id", seconds("first").alias("first_s"), seconds("last").alias("last_s"))
)
register("state_counts", "SELECT event_type AS state, count(*) AS count FROM events GROUP BY 1")(lambda s, d: events(s, d, StateSequence).state_counts())
register("state_per_sequence", "SELECT user_id, event_type AS state, count(*) AS count FROM events GROUP BY 1, 2")(lambda s, d: events(s, d, StateSequence).state_per_sequence())
register("state_proportion_per_sequence", "SELECT user_id, event_type AS state, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS proportion FROM events GROUP BY 1, 2")(
    lambda s, d: events(s, d, StateSequence).state_per_sequence(True).select("user_id", "state", r6("proportion"))
)


@register(
    "from_intervals",
    """WITH h AS (SELECT user_id AS id, CAST(floor(date_diff('second', TIMESTAMP '1970-01-01', ts) / 21600) AS BIGINT) AS a, event_type AS state, ts FROM events),
iv AS (SELECT id, a, coalesce(lead(a) OVER (PARTITION BY id ORDER BY ts, state), a + 1) AS b, state FROM h),
grid AS (SELECT id, unnest(range((SELECT min(a) FROM iv), (SELECT max(b) FROM iv) + 1)) AS t FROM (SELECT DISTINCT id FROM iv)),
last AS (SELECT id, a, max((b, state)) AS v FROM iv GROUP BY id, a)
SELECT grid.id AS id, t AS time, v[2] AS state FROM grid ASOF JOIN last ON grid.id = last.id AND grid.t >= last.a WHERE t < v[1]""",
)
def from_intervals(spark: SparkSession, d: str) -> DataFrame:
    """A user is in an event's state until the next event; sampled every six hours."""
    from pyspark.sql import Window

    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.floor(seconds("ts") / 21600).alias("start"), F.col("event_type").alias("state"), "ts")
    w = Window.partitionBy("id").orderBy("ts", "state")
    iv = rows.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("start") + 1)).select("id", "start", "end", "state")
    return sample_intervals(iv).data


register("granularity_daily", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")(
    lambda s, d: StateSequence(table(s, d, "events"), SequenceConfig("user_id", "ts", "event_type", "1d")).data.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
)
register("recode_states", "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'browse' ELSE event_type END AS state, count(*) AS count FROM events GROUP BY 1")(
    lambda s, d: events(s, d).recode_states({"view": "browse", "click": "browse"}).to_state_sequence().state_counts()
)
register("sequence_lengths", "SELECT user_id, count(*) AS length FROM events GROUP BY 1")(lambda s, d: events(s, d).sequence_lengths())


@register(
    "describe",
    """WITH l AS (SELECT count(*) AS n FROM events GROUP BY user_id)
SELECT count(*) AS n_sequences, (SELECT count(DISTINCT event_type) FROM events) AS n_states, CAST(sum(n) AS BIGINT) AS total_observations, min(n) AS min_length, max(n) AS max_length,
  round(avg(n), 6) AS mean_length, round(CAST(median(n) AS DOUBLE), 6) AS median_length FROM l""",
)
def describe(spark: SparkSession, d: str) -> DataFrame:
    r = events(spark, d).describe()
    row = (r["n_sequences"], r["n_states"], r["total_observations"], r["min_length"], r["max_length"], round(r["mean_length"], 6), float(r["median_length"]))
    return spark.createDataFrame([row], "n_sequences long, n_states long, total_observations long, min_length long, max_length long, mean_length double, median_length double")


register("get_sequence", "SELECT event_type AS state FROM events WHERE user_id = 7")(lambda s, d: events(s, d, StateSequence).get_sequence(7).select(F.col("event_type").alias("state")))
register("encoded_sequence", "SELECT row_number() OVER (ORDER BY ts, event_type) - 1 AS pos, (SELECT count(DISTINCT event_type) FROM events b WHERE b.event_type < a.event_type) AS code FROM events a WHERE user_id = 7")(
    lambda s, d: s.createDataFrame(list(enumerate(events(s, d).get_encoded_sequence(7))), "pos long, code long")
)
register("pool_iteration", "SELECT row_number() OVER (ORDER BY user_id NULLS FIRST) - 1 AS pos, user_id FROM (SELECT DISTINCT user_id FROM events)")(lambda s, d: s.createDataFrame(list(enumerate(events(s, d))), "pos long, user_id long"))
register("coerced_sts", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")(
    lambda s, d: StateSequence.coerce(SequencePool.coerce(events(s, d, StateSequence))).to_sts().groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
)


@register("load_dataframe", "SELECT event_type AS state, count(*) AS count FROM events WHERE event_type <> 'error' GROUP BY 1")
def loaded(spark: SparkSession, d: str) -> DataFrame:
    """Errors become nulls, which are dropped; the alphabet covers the rest."""
    rows = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    alphabet = Alphabet.from_column(rows, "event_type")
    return load_dataframe(rows, EVENTS, alphabet, drop_nulls=True).to_state_sequence().state_counts()


# --- filters ---------------------------------------------------------------------------------------


def _kept(name: str, criteria: list, ids_sql: str, combine: str = "and", pool=events) -> None:
    cfg = {events: EVENTS, orders: ORDERS, talks: TALKS}[pool]
    src = {events: _E, orders: _O, talks: _T}[pool]
    sql = f"WITH {src} SELECT id AS {cfg.id_column}, count(*) AS n FROM e WHERE id IN ({ids_sql}) GROUP BY 1"
    register(name, sql)(lambda s, d: filters.filter_sequences(pool(s, d), criteria, combine).data.groupBy(cfg.id_column).agg(F.count("*").alias("n")))


_LONG = "SELECT id FROM e GROUP BY id HAVING count(*) BETWEEN 10 AND 15"
_ANY = "SELECT id FROM e WHERE state IN ('system')"
_kept("filter_length", [filters.LengthCriterion(10, 15)], _LONG, pool=orders)
_kept("filter_time", [filters.TimeCriterion(start_after=-1, end_before=6)], "SELECT id FROM e GROUP BY id HAVING min(time) > -1 AND max(time) < 6", pool=talks)
_kept("filter_time_contains", [filters.TimeCriterion(contains_time=5)], "SELECT id FROM e GROUP BY id HAVING min(time) <= 5 AND max(time) >= 5", pool=talks)
_kept("filter_contains_any", [filters.ContainsStateCriterion(["system"])], _ANY, pool=talks)
_kept("filter_contains_all", [filters.ContainsStateCriterion(["1-URGENT", "5-LOW"], require_all=True)], "SELECT id FROM e WHERE state IN ('1-URGENT', '5-LOW') GROUP BY id HAVING count(DISTINCT state) = 2", pool=orders)
_kept("filter_excludes", [filters.ContainsStateCriterion(["1-URGENT"], exclude=True)], "SELECT id FROM e GROUP BY id HAVING NOT bool_or(state = '1-URGENT')", pool=orders)
_kept("filter_starts_with", [filters.StartsWithCriterion(["user", "assistant"])], "SELECT id FROM e GROUP BY id HAVING list(state ORDER BY time, state)[1:2] = ['user', 'assistant']", pool=talks)
_kept("filter_query", [filters.QueryCriterion("value > 90 AND event_type = 'purchase'")], "SELECT user_id FROM events WHERE value > 90 AND event_type = 'purchase'")
_kept("filter_and", [filters.LengthCriterion(4), filters.ContainsStateCriterion(["system"])], f"SELECT id FROM e GROUP BY id HAVING count(*) >= 4 INTERSECT {_ANY}", pool=talks)
_kept("filter_or", [filters.LengthCriterion(exact_length=2), filters.ContainsStateCriterion(["system"])], f"SELECT id FROM e GROUP BY id HAVING count(*) = 2 UNION {_ANY}", "or", talks)
register("filter_by_length", "SELECT o_custkey, count(*) AS length FROM orders GROUP BY 1 HAVING count(*) BETWEEN 10 AND 15")(lambda s, d: orders(s, d).filter_by_length(10, 15).sequence_lengths())
register("sample", "SELECT user_id, count(*) AS length FROM events WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('7:' || user_id), user_id LIMIT 10) GROUP BY 1")(lambda s, d: events(s, d).sample(10, 7).sequence_lengths())


# --- descriptive -----------------------------------------------------------------------------------


def _per(name: str, column: str, sql: str, build, pool=events) -> None:
    """A per-sequence statistic ``column`` of all sequences."""
    cfg = {events: EVENTS, orders: ORDERS, talks: TALKS}[pool]
    src = {events: _E, orders: _O, talks: _T}[pool]
    register(name, f"WITH {src}, {sql.format(id=cfg.id_column)}")(lambda s, d: build(pool(s, d)).select(cfg.id_column, r6(column)))


_K = "(SELECT count(DISTINCT state) FROM e)"
_BASIC = """p AS (SELECT id, state, CASE WHEN lag(state) OVER w <> state THEN 1 ELSE 0 END AS mv FROM e WINDOW w AS (PARTITION BY id ORDER BY time, state)),
b AS (SELECT id, count(*) AS n, CAST(sum(mv) AS BIGINT) AS mv, count(DISTINCT state) AS k FROM p GROUP BY id)"""
_per(
    "entropy",
    "entropy",
    f"c AS (SELECT id, state, count(*) AS c FROM e GROUP BY 1, 2), q AS (SELECT id, c / sum(c) OVER (PARTITION BY id) AS p FROM c) SELECT id AS {{id}}, round(-sum(p * ln(p)) / ln({_K}), 6) + 0.0 AS entropy FROM q GROUP BY id",
    lambda p: descriptive.longitudinal_entropy(p, per_sequence=True),
)
register("transition_count", f"WITH {_E}, {_BASIC} SELECT id AS user_id, mv AS n_transitions FROM b")(lambda s, d: descriptive.transition_count(events(s, d), True))
register("visited_states", f"WITH {_O}, {_BASIC} SELECT id AS o_custkey, k AS n_visited FROM b")(lambda s, d: descriptive.visited_states(orders(s, d), True).select("o_custkey", F.col("n_visited").cast("long")))
register("sequence_length", f"WITH {_O}, {_BASIC} SELECT id AS o_custkey, n AS length FROM b")(lambda s, d: descriptive.sequence_length(orders(s, d), True))
register("spell_count", f"WITH {_O}, {_BASIC} SELECT id AS o_custkey, mv + 1 AS n_spells FROM b")(lambda s, d: descriptive.spell_count(orders(s, d), True))
_per("complexity", "complexity", f"{_BASIC} SELECT id AS {{id}}, round(CASE WHEN n > 1 THEN sqrt(mv * k) / n ELSE 0 END, 6) AS complexity FROM b", lambda p: descriptive.complexity_index(p, True), orders)
_per("visited_proportion", "visited_proportion", f"{_BASIC} SELECT id AS {{id}}, round(k / {_K}, 6) AS visited_proportion FROM b", lambda p: descriptive.visited_proportion(p, True), orders)
_per("transition_proportion", "transition_proportion", f"{_BASIC} SELECT id AS {{id}}, round(CASE WHEN n > 1 THEN mv / (n - 1) ELSE 0 END, 6) AS transition_proportion FROM b", lambda p: descriptive.transition_proportion(p, True), orders)
_TURB = f"{_SPELLS}, q AS (SELECT id, count(*) AS k, var_pop(d) AS v, avg(d) AS m, sum(d) AS n FROM spells GROUP BY id), u AS (SELECT id, n, CASE WHEN k > 1 THEN greatest(0.0, log2(k * (v + 1) / m)) ELSE 0.0 END AS t FROM q)"
_per("turbulence", "turbulence", f"{_TURB} SELECT id AS {{id}}, round(t, 6) AS turbulence FROM u", lambda p: descriptive.turbulence(p, True))
_per("normalized_turbulence", "normalized_turbulence", f"{_TURB} SELECT id AS {{id}}, round(CASE WHEN n > 1 THEN t / log2(n) ELSE 0.0 END, 6) AS normalized_turbulence FROM u", lambda p: descriptive.normalized_turbulence(p, True), orders)

register("state_distribution", "SELECT event_type AS state, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS proportion FROM events GROUP BY 1")(
    lambda s, d: descriptive.state_distribution(events(s, d)).select("state", "count", r6("proportion"))
)
register("state_distribution_at_time", "SELECT role AS state, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS proportion FROM conversations WHERE turn = 2 GROUP BY 1")(
    lambda s, d: descriptive.state_distribution(talks(s, d), time_point=2).select("state", "count", r6("proportion"))
)
register("mean_time_in_state", "SELECT event_type AS state, count(*) AS total_time, round(count(*) / (SELECT count(DISTINCT user_id) FROM events), 6) AS mean_time FROM events GROUP BY 1")(
    lambda s, d: descriptive.mean_time_in_state(events(s, d)).select("state", "total_time", r6("mean_time"))
)
register(
    "modal_states_daily",
    """WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS s, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY n DESC) AS k, sum(n) OVER (PARTITION BY day) AS t FROM c) SELECT day, s AS modal_state, n AS frequency, round(n / t, 6) AS proportion FROM r WHERE k = 1""",
)(lambda s, d: descriptive.modal_states(events(s, d), "1d").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "modal_state", "frequency", r6("proportion")))
register(
    "sequence_frequency",
    "WITH p AS (SELECT conv_id, string_agg(role, '-' ORDER BY turn, role) AS sequence FROM conversations GROUP BY 1) SELECT sequence, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS proportion FROM p GROUP BY 1",
)(lambda s, d: descriptive.sequence_frequency_table(talks(s, d)).select("sequence", "count", r6("proportion")))
_per(
    "sequence_log_probability",
    "log_probability",
    f"{_STEPS}, c AS (SELECT f, t, count(*) / sum(count(*)) OVER (PARTITION BY f) AS p FROM s WHERE t IS NOT NULL GROUP BY f, t) SELECT s.id AS {{id}}, round(coalesce(sum(ln(p)), 0.0), 6) AS log_probability FROM s LEFT JOIN c USING (f, t) GROUP BY s.id",
    lambda p: descriptive.sequence_log_probability(p, True),
)
_SUBSEQ = """l AS (SELECT id, list(state ORDER BY time, state) AS st FROM e GROUP BY id),
n AS (SELECT id, st, 0 AS i, [1::HUGEINT] AS dp FROM l UNION ALL
  SELECT id, st, i + 1, list_append(dp, 2 * dp[i + 1] - coalesce(dp[list_last(list_filter(range(1, i + 1), lambda k: st[k] = st[i + 1]))], 0)) FROM n WHERE i < len(st))"""
register("subsequence_count", f"WITH RECURSIVE {_T}, {_SUBSEQ} SELECT id AS conv_id, CAST(dp[i + 1] - 1 AS BIGINT) AS n_subsequences FROM n WHERE i = len(st)".replace("list_last(", "list_max("))(
    lambda s, d: descriptive.subsequence_count(talks(s, d), per_sequence=True).select("conv_id", F.col("n_subsequences").cast("long"))
)
_per("subsequence_count_log2", "log2_n_subsequences", "", lambda p: descriptive.subsequence_count(p, use_log=True, per_sequence=True), talks)
ORACLES["subsequence_count_log2"] = f"WITH RECURSIVE {_T}, {_SUBSEQ} SELECT id AS conv_id, round(log2(CAST(dp[i + 1] AS DOUBLE)), 6) AS log2_n_subsequences FROM n WHERE i = len(st)".replace("list_last(", "list_max(")


# --- normative -------------------------------------------------------------------------------------

_SIGN = "x AS (SELECT id, time, state, CASE WHEN state IN ('purchase', 'signup') THEN 1 WHEN state = 'error' THEN -1 ELSE 0 END AS sg, CASE WHEN state = 'error' THEN 1 ELSE 0 END AS ng, row_number() OVER w AS i, count(*) OVER (PARTITION BY id) AS n FROM e WINDOW w AS (PARTITION BY id ORDER BY time, state)), y AS (SELECT *, lag(sg) OVER (PARTITION BY id ORDER BY i) AS pv FROM x)"
register(
    "individual_state_distribution",
    f"WITH {_O}, g AS (SELECT i.id, s.state FROM (SELECT DISTINCT id FROM e) i CROSS JOIN (SELECT DISTINCT state FROM e) s), c AS (SELECT id, state, count(*) AS c FROM e GROUP BY 1, 2), n AS (SELECT id, count(*) AS n FROM e GROUP BY 1) SELECT g.id AS o_custkey, g.state, coalesce(c, 0) AS count, round(coalesce(c, 0) / n, 6) AS proportion FROM g LEFT JOIN c USING (id, state) JOIN n USING (id)",
)(lambda s, d: normative.individual_state_distribution(orders(s, d)).select("o_custkey", "state", "count", r6("proportion")))


def _norm(name: str, value: str, build) -> None:
    _per(name, name, f"{_SIGN} SELECT id AS {{id}}, round(CAST({value} AS DOUBLE), 6) AS {name} FROM y GROUP BY id", build)


_norm("proportion_positive", "avg(CASE WHEN sg = 1 THEN 1 ELSE 0 END)", lambda p: normative.proportion_positive(p, POSITIVE, True))
_norm("badness", "avg(ng)", lambda p: normative.badness(p, NEGATIVE, True))
_norm("volatility", "CASE WHEN count(*) > 1 THEN sum(CASE WHEN sg * pv = -1 THEN 1 ELSE 0 END) / (count(*) - 1) ELSE 0 END", lambda p: normative.volatility(p, POSITIVE, NEGATIVE, True))
_norm("degradation", "CASE WHEN count(*) > 1 THEN sum(CASE WHEN pv = 1 AND sg = -1 THEN 1 ELSE 0 END) / (count(*) - 1) ELSE 0 END", lambda p: normative.degradation(p, POSITIVE, NEGATIVE, True))
_norm("precarity", "sum(i * ng) / (count(*) * (count(*) + 1) / 2)", lambda p: normative.precarity(p, NEGATIVE, True))
_per(
    "insecurity",
    "insecurity",
    f"{_SIGN}, z AS (SELECT id, avg(ng) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM x) SELECT id AS {{id}}, round(avg(a), 6) AS insecurity FROM z GROUP BY id",
    lambda p: normative.insecurity(p, NEGATIVE, True),
)
_per(
    "integration",
    "integration",
    f"{_SIGN}, z AS (SELECT id, avg(CASE WHEN sg = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS a FROM x) SELECT id AS {{id}}, round(avg(a), 6) AS integration FROM z GROUP BY id",
    lambda p: normative.integration(p, POSITIVE, True),
)
_per("objective_volatility", "objective_volatility", f"{_BASIC} SELECT id AS {{id}}, round(CASE WHEN n > 1 THEN 0.5 * (k - 1) / ({_K} - 1) + 0.5 * mv / (n - 1) ELSE 0 END, 6) AS objective_volatility FROM b", lambda p: normative.objective_volatility(p, 0.5, True), orders)
register(
    "integration_by_state",
    f"WITH {_E}, {_SIGN}, a AS (SELECT DISTINCT state AS s FROM e), z AS (SELECT s, id, avg(CASE WHEN state = s THEN 1 ELSE 0 END) OVER (PARTITION BY s, id ORDER BY i ROWS UNBOUNDED PRECEDING) AS v FROM x CROSS JOIN a), q AS (SELECT s, id, avg(v) AS v FROM z GROUP BY 1, 2) SELECT s AS state, round(avg(v), 6) AS integration FROM q GROUP BY 1",
)(lambda s, d: normative.integration(events(s, d)).select("state", r6("integration")))


# --- transitions and costs -------------------------------------------------------------------------

_RATES = f"{_STEPS}, al AS (SELECT DISTINCT state FROM e), g AS (SELECT x.state AS f, y.state AS t FROM al x CROSS JOIN al y), c AS (SELECT f, t, count(*) AS c FROM s WHERE t IS NOT NULL GROUP BY f, t), n AS (SELECT g.f, g.t, coalesce(c, 0) AS c FROM g LEFT JOIN c USING (f, t)), r AS (SELECT f, t, c, coalesce(c / nullif(sum(c) OVER (PARTITION BY f), 0), 0.0) AS p FROM n)"
register("transition_rates", f"WITH {_O}, {_RATES} SELECT f AS from_state, t AS to_state, c AS count, round(p, 6) AS rate FROM r")(lambda s, d: transitions.transition_rates(orders(s, d)).select("from_state", "to_state", "count", r6("rate")))
register("transition_rates_no_self", f"WITH {_O}, {_RATES} SELECT f AS from_state, t AS to_state, c AS count, round(c / sum(c) OVER (PARTITION BY f), 6) AS rate FROM n WHERE f <> t")(
    lambda s, d: transitions.transition_rates(orders(s, d), True).select("from_state", "to_state", "count", r6("rate"))
)
register("first_occurrence", f"SELECT user_id, {_SECS.format('min(ts)')} AS first_s FROM events WHERE event_type = 'purchase' GROUP BY 1")(
    lambda s, d: transitions.first_occurrence_time(events(s, d), "purchase").select("user_id", seconds("first_time").alias("first_s"))
)
register(
    "state_spell_stats",
    f"WITH {_E}, {_SPELLS} SELECT state, round(avg(d), 6) AS mean_duration, round(CAST(median(d) AS DOUBLE), 6) AS median_duration, min(d) AS min_duration, max(d) AS max_duration, round(stddev_samp(d), 6) AS std_duration, count(*) AS n_spells FROM spells GROUP BY 1",
)(lambda s, d: transitions.state_spell_stats(events(s, d)).select("state", r6("mean_duration"), r6("median_duration"), "min_duration", "max_duration", r6("std_duration"), "n_spells"))

QUERIES["state_duration_stats"] = lambda s, d: transitions.state_duration_stats(events(s, d)).select("state", r6("mean_duration"), r6("median_duration"), "min_duration", "max_duration", r6("std_duration"), "n_spells")
ORACLES["state_duration_stats"] = ORACLES["state_spell_stats"]

_FREQ = "al AS (SELECT state, count(*) / (SELECT count(*) FROM e) AS p FROM e GROUP BY 1)"


def _costs(name: str, value: str, build, extra: str = _FREQ) -> None:
    sql = f"WITH {_O}, {extra} SELECT x.state AS from_state, y.state AS to_state, CASE WHEN x.state = y.state THEN 0.0 ELSE round({value}, 6) END AS cost FROM al x CROSS JOIN al y"
    register(f"substitution_costs_{name}", sql)(lambda s, d: (lambda p: transitions.costs_frame(p, build(p)).select("from_state", "to_state", r6("cost")))(orders(s, d)))


def _built(p: SequencePool, method: str, **kw) -> np.ndarray:
    return transitions.build_substitution_matrix(len(p.alphabet), method, **kw)


_costs("constant", "2.0", lambda p: transitions.substitution_cost_matrix(p, "constant"))
_costs("trate", "2 - (SELECT p FROM r WHERE f = x.state AND t = y.state) - (SELECT p FROM r WHERE f = y.state AND t = x.state)", transitions.substitution_cost_matrix, _RATES)
_costs("indels", "1 / x.p + 1 / y.p", lambda p: _built(p, "indels", state_frequencies=transitions.state_frequencies(p)))
_costs("indelslog", "ln(1 / x.p) + ln(1 / y.p)", lambda p: _built(p, "indelslog", state_frequencies=transitions.state_frequencies(p)))
_costs("future", "(SELECT sum((a.p - b.p) * (a.p - b.p) / (a.p + b.p)) FROM r a JOIN r b ON a.t = b.t WHERE a.f = x.state AND b.f = y.state)", lambda p: _built(p, "future", transition_rates=transitions.transition_rate_matrix(p)), _RATES)
_costs("features", "abs(x.p - y.p) / ((SELECT max(p) FROM al) - (SELECT min(p) FROM al))", lambda p: _built(p, "features", features=transitions.state_frequencies(p)))


# --- pairwise distances ----------------------------------------------------------------------------


def _pairs(p: SequencePool, method: str, **options) -> DataFrame:
    return distances.compute(p, method, **options).rounded_pairs(6).select("id_a", "id_b", "distance")


_H = """u AS (SELECT user_id AS id, hour(ts) AS time, event_type AS state, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
md AS (SELECT id, time, (min((-n, state)))[2] AS state FROM u GROUP BY 1, 2),
e AS (SELECT i.id, CAST(h AS BIGINT) AS time, coalesce(md.state, 'none') AS state FROM (SELECT DISTINCT id FROM u) i CROSS JOIN range(24) t(h) LEFT JOIN md ON md.id = i.id AND md.time = h)"""
_LISTS = "l AS (SELECT id, list(state ORDER BY time, state) AS st, count(*) AS n FROM e GROUP BY id)"
_P = f"{_LISTS}, p AS (SELECT a.id AS id_a, b.id AS id_b, a.st AS x, b.st AS y, a.n AS nx, b.n AS ny FROM l a JOIN l b ON a.id < b.id)"
_PREFIX = "coalesce(list_min(list_filter(range(1, least(nx, ny) + 1), lambda k: {x}[k] <> {y}[k])) - 1, least(nx, ny))"

register("dist_hamming", f"WITH {_H}, {_P} SELECT id_a, id_b, CAST(len(list_filter(range(1, nx + 1), lambda k: x[k] <> y[k])) AS DOUBLE) AS distance FROM p")(lambda s, d: _pairs(hours(s, d), "hamming"))
register(
    "dist_dhd",
    f"""WITH {_H}, n AS (SELECT count(DISTINCT id) AS n FROM e), f AS (SELECT time, state, count(*) / any_value(n.n) AS f FROM e, n GROUP BY 1, 2)
SELECT a.id AS id_a, b.id AS id_b, round(sum(CASE WHEN a.state = b.state THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - fa.f * fb.f / 0.25)) END), 6) AS distance
FROM e a JOIN e b ON a.time = b.time AND a.id < b.id JOIN f fa ON fa.time = a.time AND fa.state = a.state JOIN f fb ON fb.time = b.time AND fb.state = b.state GROUP BY 1, 2""",
)(lambda s, d: _pairs(hours(s, d), "dhd"))
register("dist_lcp", f"WITH {_E}, {_P} SELECT id_a, id_b, CAST(nx + ny - 2 * {_PREFIX.format(x='x', y='y')} AS DOUBLE) AS distance FROM p")(lambda s, d: _pairs(events(s, d), "lcp"))
register(
    "dist_rlcp",
    f"WITH {_E}, {_P}, q AS (SELECT id_a, id_b, nx, ny, list_reverse(x) AS x, list_reverse(y) AS y FROM p) SELECT id_a, id_b, CAST(nx + ny - 2 * {_PREFIX.format(x='x', y='y')} AS DOUBLE) AS distance FROM q",
)(lambda s, d: _pairs(events(s, d), "rlcp"))
_COUNTS = "k AS (SELECT i.id, s.state, count(e.id) AS c, any_value(t.n) AS n FROM (SELECT DISTINCT id FROM e) i CROSS JOIN (SELECT DISTINCT state FROM e) s LEFT JOIN e ON e.id = i.id AND e.state = s.state JOIN (SELECT id, count(*) AS n FROM e GROUP BY id) t ON t.id = i.id GROUP BY 1, 2)"
register("dist_euclidean", f"WITH {_E}, {_COUNTS} SELECT a.id AS id_a, b.id AS id_b, round(sqrt(sum((a.c / a.n - b.c / b.n) * (a.c / a.n - b.c / b.n))), 6) AS distance FROM k a JOIN k b ON a.state = b.state AND a.id < b.id GROUP BY 1, 2")(
    lambda s, d: _pairs(events(s, d), "euclidean")
)
register("dist_chi2", f"WITH {_E}, {_COUNTS} SELECT a.id AS id_a, b.id AS id_b, round(0.5 * sum(CASE WHEN a.c + b.c > 0 THEN (a.c - b.c) * (a.c - b.c) / (a.c + b.c) ELSE 0 END), 6) AS distance FROM k a JOIN k b ON a.state = b.state AND a.id < b.id GROUP BY 1, 2")(
    lambda s, d: _pairs(events(s, d), "chi2")
)
register(
    "dist_svrspell",
    f"""WITH {_T}, {_SPELLS}, r AS (SELECT id, state, d, row_number() OVER (PARTITION BY id, state ORDER BY d DESC) AS k FROM spells), i AS (SELECT DISTINCT id FROM e),
pr AS (SELECT a.id AS id_a, b.id AS id_b FROM i a JOIN i b ON a.id < b.id),
v AS (SELECT id_a, id_b, state, k, d AS v FROM pr JOIN r ON r.id = id_a UNION ALL SELECT id_a, id_b, state, k, -d FROM pr JOIN r ON r.id = id_b),
s AS (SELECT id_a, id_b, state, k, abs(sum(v)) AS v FROM v GROUP BY ALL) SELECT id_a, id_b, CAST(sum(v) AS DOUBLE) AS distance FROM s GROUP BY 1, 2""",
)(lambda s, d: _pairs(talks(s, d), "svrspell"))
_WORD = "l AS (SELECT id, string_agg(chr(96 + CAST(dr AS INT)), '' ORDER BY time, state) AS st FROM (SELECT *, dense_rank() OVER (ORDER BY state) AS dr FROM e) GROUP BY id)"
register("dist_om_unit", f"WITH {_E}, {_WORD} SELECT a.id AS id_a, b.id AS id_b, CAST(levenshtein(a.st, b.st) AS DOUBLE) AS distance FROM l a JOIN l b ON a.id < b.id")(lambda s, d: _pairs(events(s, d), "om", sub_cost=1.0))


def _dp(cell: str, top: str, side: str, out: str, extra: str = "", carry: str = "0", pool: str = _T, pairs: str = "") -> str:
    """SQL that fills a DP table row by row. In ``cell``: dg, up, lf, i and j from 1, and mp, the value of ``carry``."""
    cell = cell.replace("dg", "r[j]").replace("up", "r[j + 1]").replace("lf", "acc[-1]")
    cell = re.sub(r"\bi\b", "(i0 + 1)", re.sub(r"\bj\b", "CAST(q[1] AS INT)", cell))
    side = re.sub(r"\bi\b", "(i0 + 1)", side)
    met = f"{_LISTS}, p AS (SELECT id_a, id_b, a.st AS x, b.st AS y, a.n AS nx, b.n AS ny FROM {pairs} JOIN l a ON a.id = id_a JOIN l b ON b.id = id_b)" if pairs else _P
    return f"""WITH RECURSIVE {pool}{extra}, {met}, mp AS (SELECT {carry} AS mp),
dp AS (SELECT id_a, id_b, x, y, nx, ny, mp, 0 AS i0, list_prepend(CAST(0 AS DOUBLE), list_transform(range(1, ny + 1), lambda j: CAST({top} AS DOUBLE))) AS r FROM p CROSS JOIN mp
UNION ALL SELECT id_a, id_b, x, y, nx, ny, mp, i0 + 1, list_reduce(list_prepend([CAST({side} AS DOUBLE)], list_transform(range(1, ny + 1), lambda k: [CAST(k AS DOUBLE)])), lambda acc, q: list_append(acc, CAST({cell} AS DOUBLE))) FROM dp WHERE i0 < nx)
SELECT id_a, id_b, round({out}, 6) AS distance FROM dp WHERE i0 = nx"""


_SUB2 = "CASE WHEN x[i] = y[j] THEN 0.0 ELSE 2.0 END"
_EDIT = "least(up + 1, lf + 1, dg + {sub})"
register("dist_om", _dp(_EDIT.format(sub=_SUB2), "j", "i", "r[ny + 1]"))(lambda s, d: _pairs(talks(s, d), "om"))
register("dist_om_normalized", _dp(_EDIT.format(sub=_SUB2), "j", "i", "r[ny + 1] / greatest(nx, ny)"))(lambda s, d: _pairs(talks(s, d), "om", normalize=True))
register("dist_lcs", _dp(_EDIT.format(sub=_SUB2), "j", "i", "r[ny + 1]"))(lambda s, d: _pairs(talks(s, d), "lcs"))
register(
    "dist_om_trate",
    _dp(_EDIT.format(sub="CASE WHEN x[i] = y[j] THEN 0.0 ELSE 2 - mp[x[i] || '>' || y[j]] - mp[y[j] || '>' || x[i]] END"), "j", "i", "r[ny + 1]", f", {_RATES}", "(SELECT map(list(f || '>' || t), list(p)) FROM r)"),
)(lambda s, d: (lambda p: _pairs(p, "om", sm=transitions.substitution_cost_matrix(p)))(talks(s, d)))
_DEPTH = "(least({i} - 1, {n} - {i}) / greatest({n} - 1, 1))"
register("dist_omloc", _dp(_EDIT.format(sub=f"{_SUB2} * (1 + (1 - ({_DEPTH.format(i='i', n='nx')} + {_DEPTH.format(i='j', n='ny')}) / 2))"), "j", "i", "r[ny + 1]"))(lambda s, d: _pairs(talks(s, d), "omloc"))
_RUN = "sqrt(CAST(len(list_filter(range(1, nx + 1), lambda h: list_unique(x[least(h, i):greatest(h, i)]) = 1)) * len(list_filter(range(1, ny + 1), lambda h: list_unique(y[least(h, j):greatest(h, j)]) = 1)) AS DOUBLE))"
register("dist_omspell", _dp(_EDIT.format(sub=f"{_SUB2} / {_RUN}"), "j", "i", "r[ny + 1]"))(lambda s, d: _pairs(talks(s, d), "omspell"))
register(
    "dist_omstran",
    _dp(_EDIT.format(sub=f"{_SUB2} + CASE WHEN i > 1 AND j > 1 THEN abs((CASE WHEN x[i - 1] = x[i] THEN 1.0 ELSE 0.0 END) - (CASE WHEN y[j - 1] = y[j] THEN 1.0 ELSE 0.0 END)) ELSE 0.0 END"), "j", "i", "r[ny + 1]"),
)(lambda s, d: _pairs(talks(s, d), "omstran"))
register("dist_dtw", _dp("CASE WHEN x[i] = y[j] THEN 0.0 ELSE 1.0 END + least(up, lf, dg)", "CAST('inf' AS DOUBLE)", "CAST('inf' AS DOUBLE)", "r[ny + 1]"))(lambda s, d: _pairs(talks(s, d), "dtw"))
# A cell also carries the steps of its path: up, then left, then the diagonal where they tie. Cells are (distance, steps).
_STEP = "CASE WHEN {u}[1] <= {l}[1] AND {u}[1] <= {d}[1] THEN {u} WHEN {l}[1] <= {d}[1] THEN {l} ELSE {d} END".format(u="r[CAST(q[1] AS INT) + 1]", l="acc[-1]", d="r[CAST(q[1] AS INT)]")
_WARP = f"""WITH RECURSIVE {_T}, {_P}, dp AS (SELECT id_a, id_b, x, y, nx, ny, 0 AS i, list_prepend([0.0::DOUBLE, 0.0::DOUBLE], list_transform(range(1, ny + 1), lambda j: ['inf'::DOUBLE, 0.0::DOUBLE])) AS r FROM p
UNION ALL SELECT id_a, id_b, x, y, nx, ny, i + 1, list_reduce(list_prepend([['inf'::DOUBLE, 0.0::DOUBLE]], list_transform(range(1, ny + 1), lambda k: [[k::DOUBLE]])),
  lambda acc, w: list_append(acc, CASE WHEN abs(i + 1 - w[1][1]) > 3 THEN ['inf'::DOUBLE, 0.0::DOUBLE] ELSE list_transform([{_STEP.replace('q[1]', 'w[1][1]')}], lambda b: [b[1] + CASE WHEN x[i + 1] = y[CAST(w[1][1] AS INT)] THEN 0.0 ELSE 1.0 END, b[2] + 1])[1] END)) FROM dp WHERE i < nx)
SELECT id_a, id_b, round(r[ny + 1][1] / greatest(r[ny + 1][2], 1), 6) AS distance FROM dp WHERE i = nx"""
register("dist_dtw_normalized", _WARP)(lambda s, d: _pairs(talks(s, d), "dtw", window=3, normalize=True))
_LOW = "least(up, lf, dg)"
_SOFT = f"CASE WHEN x[i] = y[j] THEN 0.0 ELSE 1.0 END + {_LOW} - ln(exp({_LOW} - up) + exp({_LOW} - lf) + exp({_LOW} - dg))"
register("dist_softdtw", _dp(_SOFT, "CAST('inf' AS DOUBLE)", "CAST('inf' AS DOUBLE)", "r[ny + 1]"))(lambda s, d: _pairs(talks(s, d), "softdtw"))
_DROP = "(1 + CASE WHEN {i} > 1 THEN 0.001 + CASE WHEN {x}[{i}] <> {x}[{i} - 1] THEN 1 ELSE 0 END ELSE 0 END)"
_TWED = f"least(dg + CASE WHEN x[i] <> y[j] THEN 1.0 ELSE 0.0 END + 0.001 * abs(i - j) * CASE WHEN i > 1 AND j > 1 THEN 2 ELSE 1 END + CASE WHEN i > 1 AND j > 1 AND x[i - 1] <> y[j - 1] THEN 1.0 ELSE 0.0 END, up + {_DROP.format(i='i', x='x')}, lf + {_DROP.format(i='j', x='y')})"
register(
    "dist_twed",
    _dp(_TWED, f"list_sum(list_transform(range(1, j + 1), lambda h: {_DROP.format(i='h', x='y')}))", f"list_sum(list_transform(range(1, i + 1), lambda h: {_DROP.format(i='h', x='x')}))", "r[ny + 1]"),
)(lambda s, d: _pairs(talks(s, d), "twed"))
# Embeddings of both and of each alone: the pairs then also hold every sequence with itself.
_NMS = _dp("up + lf - dg + CASE WHEN x[i] = y[j] THEN dg + 1 ELSE 0.0 END", "0.0", "0.0", "r[ny + 1]").replace("a.id < b.id", "a.id <= b.id")
_NMS = f"WITH n AS ({_NMS}) SELECT n.id_a, n.id_b, round({{}}, 6) AS distance FROM n JOIN n a ON a.id_a = n.id_a AND a.id_b = n.id_a JOIN n b ON b.id_a = n.id_b AND b.id_b = n.id_b WHERE n.id_a < n.id_b"
register("dist_nms", _NMS.format("1 - n.distance / greatest(a.distance, b.distance)"))(lambda s, d: _pairs(talks(s, d), "nms"))
register("dist_nmsmst", _NMS.format("greatest(0.0, 1 - n.distance / sqrt(a.distance * b.distance))"))(lambda s, d: _pairs(talks(s, d), "nmsmst"))


# --- clustering, quality, discrepancy --------------------------------------------------------------


def _by_three(p: SequencePool) -> DataFrame:
    return p.base.select("id").distinct().withColumn("cluster", F.pmod(F.col("id"), F.lit(3)).cast("int"))


_D = f"{_E}, {_COUNTS}, d AS (SELECT a.id AS i, b.id AS j, sqrt(sum((a.c / a.n - b.c / b.n) * (a.c / a.n - b.c / b.n))) AS d FROM k a JOIN k b ON a.state = b.state AND a.id <> b.id GROUP BY 1, 2), g AS (SELECT id, id % 3 AS c, count(*) OVER (PARTITION BY id % 3) AS m FROM (SELECT DISTINCT id FROM e))"
_SIL = f"{_D}, z AS (SELECT i, gi.c AS ci, gj.c AS cj, any_value(gj.m) AS m, sum(d) AS s FROM d JOIN g gi ON gi.id = i JOIN g gj ON gj.id = j GROUP BY 1, 2, 3), ab AS (SELECT i, ci, coalesce(sum(s / greatest(m - 1, 1)) FILTER (ci = cj), 0) AS a, min(s / m) FILTER (ci <> cj) AS b FROM z GROUP BY 1, 2)"
register("silhouette", f"WITH {_SIL} SELECT i AS id, CAST(ci AS INT) AS cluster, round(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS silhouette FROM ab")(
    lambda s, d: (lambda p: clustering.silhouette_frame(distances.compute(p, "euclidean").pairs, _by_three(p)).select("id", "cluster", r6("silhouette")))(events(s, d))
)
_SS = "t AS (SELECT sum(d * d) / 2 / (SELECT count(*) FROM g) AS st FROM d), wi AS (SELECT sum(x / m) AS sw FROM (SELECT gi.c, any_value(gi.m) AS m, sum(d * d) / 2 AS x FROM d JOIN g gi ON gi.id = i JOIN g gj ON gj.id = j WHERE gi.c = gj.c GROUP BY 1))"
register(
    "cluster_quality",
    f"WITH {_SIL}, {_SS}, co AS (SELECT corr(d, CASE WHEN gi.c = gj.c THEN 1.0 ELSE 0.0 END) AS r FROM d JOIN g gi ON gi.id = i JOIN g gj ON gj.id = j WHERE i < j) SELECT round((SELECT avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) FROM ab), 6) AS asw, round(r, 6) AS pbc, round(-r, 6) AS hg, round(1 - sw / st, 6) AS r2 FROM co, t, wi",
)(lambda s, d: (lambda p: clustering.cluster_quality_frame(distances.compute(p, "euclidean"), _by_three(p)).select(r6("asw"), r6("pbc"), r6("hg"), r6("r2")))(events(s, d)))
register("distance_to_center", f"WITH {_D} SELECT i AS id, CAST(gi.c AS INT) AS cluster, round(avg(d), 6) AS distance_to_center FROM d JOIN g gi ON gi.id = i JOIN g gj ON gj.id = j WHERE gi.c = gj.c GROUP BY 1, 2")(
    lambda s, d: (lambda p: clustering.distance_to_center_frame(distances.compute(p, "euclidean").pairs, _by_three(p)).select("id", "cluster", r6("distance_to_center")))(events(s, d))
)


def _typical(strategy: str, score: str, order: str) -> None:
    sql = f"WITH {_D}, h AS (SELECT median(d) AS h FROM d WHERE i < j) SELECT i AS id, round({score}, 6) AS score FROM d, h GROUP BY i ORDER BY round({score}, 9) {order}, i LIMIT 4"
    register(f"representatives_{strategy}", sql)(lambda s, d: clustering.representatives_frame(distances.compute(events(s, d), "euclidean"), strategy).select("id", r6("score")))


_typical("centrality", "sum(d)", "ASC")
_typical("frequency", "CAST(sum(CASE WHEN d > 0 AND d <= h THEN 1 ELSE 0 END) AS DOUBLE)", "DESC")
_typical("density", "sum(exp(-0.5 * (d / h) * (d / h))) + 1", "DESC")

_DISC = f"{_SS}, f AS (SELECT count(*) AS n, count(DISTINCT c) AS k FROM g)"
register(
    "discrepancy",
    f"WITH {_D}, {_DISC} SELECT k AS n_groups, round(st, 6) AS ss_total, round(sw, 6) AS ss_within, round(st - sw, 6) AS ss_between, round((st - sw) / st, 6) AS pseudo_r2, round(((st - sw) / (k - 1)) / (sw / (n - k)), 6) AS pseudo_f FROM t, wi, f",
)(lambda s, d: (lambda p: discrepancy.discrepancy_frame(distances.compute(p, "euclidean").pairs, _by_three(p)).select("n_groups", *(r6(c) for c in ("ss_total", "ss_within", "ss_between", "pseudo_r2", "pseudo_f"))))(events(s, d)))


_TALK_OM = _dp(_EDIT.format(sub=_SUB2), "j", "i", "r[ny + 1]")


@register("multi_factor_discrepancy", oracles.permutations(_TALK_OM, {"parity": "id % 2", "third": "id % 3"}, 99, 1))
def multi_factor(spark: SparkSession, d: str) -> DataFrame:
    dm = distances.compute(talks(spark, d), "om")
    factors = {"parity": [x % 2 for x in dm.labels], "third": [x % 3 for x in dm.labels]}
    out = discrepancy.multi_factor_discrepancy(dm, factors, 99, 1)
    rows = [(k, *(round(float(x), 6) for x in (r.pseudo_r2, r.pseudo_f, r.p_value))) for k, r in out.items()]
    return spark.createDataFrame(rows, "factor string, pseudo_r2 double, pseudo_f double, p_value double")


@register("discrepancy_permutation", f"SELECT pseudo_r2, pseudo_f, p_value FROM ({oracles.permutations(_TALK_OM, {'third': 'id % 3'}, 199, 1)})")
def discrepancy_permutation(spark: SparkSession, d: str) -> DataFrame:
    dm = distances.compute(talks(spark, d), "om")
    r = discrepancy.discrepancy_analysis(dm, [x % 3 for x in dm.labels], 199, 1)
    return spark.createDataFrame([tuple(round(float(x), 6) for x in (r.pseudo_r2, r.pseudo_f, r.p_value))], "pseudo_r2 double, pseudo_f double, p_value double")


register("pam", oracles.pam(_TALK_OM, 3))(lambda s, d: clustering.pam_clustering(distances.compute(talks(s, d), "om"), 3).to_dataframe(s))
register("clara", oracles.clara(_TALK_OM, 3, 5, 1))(lambda s, d: clustering.clara_clustering(distances.compute(talks(s, d), "om"), 3, random_state=1).to_dataframe(s))


def _clara_pool_sql(k: int, samples: int, size: int) -> str:
    """Samples of a pool by MD5, PAM on each, all sequences against the medoids."""
    om = lambda pairs: _dp(_EDIT.format(sub=_SUB2), "j", "i", "r[ny + 1]", pool=_O, pairs=pairs)
    drawn = f"dr AS (SELECT s, id FROM (SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY md5(s || ':' || id)) AS o FROM (SELECT DISTINCT o_custkey AS id FROM orders) CROSS JOIN range({samples}) t(s)) WHERE o <= {size})"
    within = om("(SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM dr a JOIN dr b ON a.s = b.s AND a.id < b.id)")
    runs = f"SELECT s AS run, list(i ORDER BY i) AS s, {k} AS k FROM dr JOIN ids USING (id) GROUP BY dr.s"
    found = f"""WITH RECURSIVE {drawn}, {oracles.matrix(within)}, {oracles.medoids(runs)}
SELECT run, c, ids.id AS medoid FROM (SELECT run, unnest(med) AS i, unnest(range(0, len(med))) AS c FROM md) JOIN ids USING (i)"""
    to = om("(SELECT DISTINCT e.id AS id_a, medoid AS id_b FROM e, mds)")
    return f"""WITH mds AS ({found}), dist AS ({to}), z AS (SELECT run, id_a AS id, min((distance, c)) AS b FROM dist JOIN mds ON medoid = id_b GROUP BY ALL),
best AS (SELECT min((t, run))[2] AS run FROM (SELECT run, sum(b[1]) AS t FROM z GROUP BY run))
SELECT id, CAST(b[2] AS INT) AS cluster, b[1] AS distance FROM z JOIN best USING (run)"""


register("clara_pool", _clara_pool_sql(4, 5, 48))(lambda s, d: clustering.clara_pool(orders(s, d), 4)[0])


@register("pam_range", oracles.pam_range(_TALK_OM, 2, 5))
def pam_range(spark: SparkSession, d: str) -> DataFrame:
    rows = clustering.pam_range(distances.compute(talks(spark, d), "om"), clustering.k_range(2, 5))
    return spark.createDataFrame([(r["k"], *(round(float(r[c]), 6) for c in ("ASW", "R2", "total_cost"))) for r in rows], "k int, asw double, r2 double, total_cost double")


def _first_of(result: DataFrame) -> DataFrame:
    """Each id with the least id of its cluster: clusters whatever their numbers."""
    first = result.groupBy("cluster").agg(F.min("id").alias("cluster_first"))
    return result.join(first, "cluster").select("id", "cluster_first")


for _m in ("ward", "complete", "average", "single"):
    register(f"hierarchical_{_m}", oracles.linkage(_TALK_OM, _m, 4))(lambda s, d, m=_m: _first_of(clustering.hierarchical_clustering(distances.compute(talks(s, d), "om"), 4, m).to_dataframe(s)))


@register("dissimilarity_tree", oracles.tree(_TALK_OM, "SELECT conv_id AS id, count(*) AS turns, conv_id % 2 AS parity FROM conversations GROUP BY conv_id", ["turns", "parity"]))
def dissimilarity_tree(spark: SparkSession, d: str) -> DataFrame:
    """Conversations by their number of turns and the parity of their id."""
    p = talks(spark, d)
    dm = distances.compute(p, "om")
    lengths = p.sequence_lengths().where("conv_id is not null").limit(distances.MAX_IDS).toArrow()
    turns = dict(zip(lengths["conv_id"].to_pylist(), lengths["length"].to_pylist()))
    out = discrepancy.dissimilarity_tree(dm, np.array([[turns[x], x % 2] for x in dm.labels]), ["turns", "parity"]).to_dataframe(spark)
    return out.withColumn("pseudo_r2", F.round("pseudo_r2", 6))


@register("pam_predict", f"SELECT id, cluster FROM ({oracles.pam(_TALK_OM, 3)})")
def pam_predict(spark: SparkSession, d: str) -> DataFrame:
    """The fitted sequences as if they were new ones."""
    dm = distances.compute(talks(spark, d), "om")
    model = clustering.PAMClustering(3).fit(dm)
    return clustering.frame(spark, {"id": dm.labels, "cluster": model.predict(dm).astype(np.int32)})


@register("pam_inits", "SELECT init, 3 AS n_medoids, 0 AS n_better_swaps FROM (VALUES ('build'), ('random'), ('k-medoids++')) t(init)")
def pam_inits(spark: SparkSession, d: str) -> DataFrame:
    """Whatever the start, no swap lowers the cost of the medoids found."""
    dm = distances.compute(talks(spark, d), "om")
    c, rows = dm.classes, []
    for init in ("build", "random", "k-medoids++"):
        found = clustering.pam_clustering(dm, 3, init=init, random_state=5)
        medoids = [int(x) for x in found.medoid_indices]
        # All members of a class lower the cost alike; a medoid itself is no swap.
        swaps = [([*c.of[medoids[:m]], u, *c.of[medoids[m + 1 :]]], c.size[u] - (c.of[medoids] == u).sum()) for m in range(3) for u in range(len(c.size))]
        better = sum(others for o, others in swaps if c.size @ c.dense[:, o].min(1) < found.total_cost)
        rows.append((init, len(set(medoids)), int(better)))
    return spark.createDataFrame(rows, "init string, n_medoids int, n_better_swaps int")


register("hierarchical_class", ORACLES["hierarchical_average"])(
    lambda s, d: _first_of(clustering.HierarchicalClustering(4, "average").fit(distances.compute(talks(s, d), "om")).result.to_dataframe(s))
)


@register("distance_matrix", f"WITH d AS ({_TALK_OM}) SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS n, count(*) AS n_pairs, sum(distance) AS total, sum(distance) AS total_again FROM d")
def distance_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A dense matrix of the different sequences, and the same from its condensed form; both summed over all pairs of sequences."""
    dm = distances.compute(talks(spark, d), "om")
    c = dm.classes
    again = distances.DistanceMatrix.from_condensed(distances.DistanceMatrix(values=c.dense).to_condensed(), [dm.labels[x] for x in c.first])
    first, last = dm.labels[0], dm.labels[int(c.first[-1])]
    assert again.get_distance(last, first) == c.dense[0, -1]
    total, total_again = (float(c.size @ x @ c.size / 2) for x in (c.dense, again.values))
    return spark.createDataFrame([(dm.n, dm.n * (dm.n - 1) // 2, total, total_again)], "n long, n_pairs long, total double, total_again double")


_MATRIX_LABELS = "lab AS (SELECT conv_id AS id, conv_id % 3 AS c FROM (SELECT DISTINCT conv_id FROM conversations))"
_BOTH = f"od AS ({_TALK_OM}), d AS (SELECT id_a AS i, id_b AS j, distance AS d FROM od UNION ALL SELECT id_b, id_a, distance FROM od), {_MATRIX_LABELS}, g AS (SELECT id, c, count(*) OVER (PARTITION BY c) AS m FROM lab)"
_AB = _SIL[_SIL.index("z AS (SELECT") :]


@register("matrix_quality", f"WITH {_BOTH}, {_AB} SELECT i AS id, round(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS silhouette, round(a, 6) AS distance_to_center FROM ab")
def matrix_quality(spark: SparkSession, d: str) -> DataFrame:
    """Silhouettes and distances to the centre of a dense matrix."""
    dm = distances.compute(talks(spark, d), "om")
    labels = [x % 3 for x in dm.labels]
    s, c = clustering.silhouette_scores(dm, labels), clustering.distance_to_center(dm, labels)
    return clustering.frame(spark, {"id": dm.labels, "silhouette": np.round(s, 6), "distance_to_center": np.round(c, 6)})


@register("representatives_by_cluster", f"WITH {_BOTH} SELECT id, cluster, score FROM (SELECT i AS id, gi.c AS cluster, sum(d) AS score, row_number() OVER (PARTITION BY gi.c ORDER BY sum(d), i) AS r FROM d JOIN g gi ON gi.id = i JOIN g gj ON gj.id = j WHERE gi.c = gj.c GROUP BY 1, 2) WHERE r <= 2")
def representatives_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    dm = distances.compute(talks(spark, d), "om")
    r = clustering.extract_representatives(dm, 6, "centrality", [x % 3 for x in dm.labels])
    return spark.createDataFrame([(dm.labels[i], int(c), float(s)) for i, c, s in zip(r.indices, r.cluster_labels, r.scores)], "id long, cluster long, score double")


_PAIR = f"WITH {_T}, {_P}, {_COUNTS.replace('k AS (', 'kk AS (', 1)}, ch AS (SELECT a.id AS id_a, b.id AS id_b, sum(CASE WHEN a.c + b.c > 0 THEN (1 + r) * (a.c - b.c) * (a.c - b.c) / (a.c + b.c) ELSE 0 END) / 2 AS chi2_weighted FROM (SELECT *, dense_rank() OVER (ORDER BY state) - 1 AS r FROM kk) a JOIN kk b ON a.state = b.state AND a.id < b.id GROUP BY 1, 2)"


@register(
    "pair_functions",
    f"""{_PAIR}, lc AS ({_dp(_EDIT.format(sub=_SUB2), "j", "i", "r[ny + 1]")})
SELECT p.id_a, p.id_b, round((nx + ny - distance) / 2 / greatest(nx, ny), 6) AS lcs_similarity, round({_PREFIX.format(x='x', y='y')} / least(nx, ny), 6) AS lcp_similarity, round(chi2_weighted, 6) AS chi2_weighted
FROM p JOIN lc ON lc.id_a = p.id_a AND lc.id_b = p.id_b JOIN ch ON ch.id_a = p.id_a AND ch.id_b = p.id_b""",
)
def pair_functions(spark: SparkSession, d: str) -> DataFrame:
    """Single-pair functions on a tile's pairs of different sequences, each pair by itself."""
    pool = talks(spark, d)
    seqs, k, n, *_ = distances.coded(pool)
    weights = [1.0 + x for x in range(k)]

    single = {"lcs_similarity": distances.lcs_similarity, "lcp_similarity": distances.lcp_similarity, "chi2_weighted": lambda a, b: distances.chi2_distance_weighted(a, b, weights, k)}

    def each(function):
        return lambda codes: lambda i, j: np.array([function(codes[x], codes[y]) for x, y in zip(i, j)], float)

    return distances.tile_pairs(seqs, n, {name: each(f) for name, f in single.items()}, symmetric=True, digits=6)


# --- mining ----------------------------------------------------------------------------------------

_MINE = """l AS (SELECT id, list(state ORDER BY time, state) AS st FROM e GROUP BY id), al AS (SELECT DISTINCT state FROM e), n AS (SELECT count(*) AS n FROM l),
w AS (SELECT id, 1 AS len, [state] AS s, list_position(st, state) AS pos, st FROM l CROSS JOIN al WHERE list_contains(st, state) UNION ALL
  SELECT id, len + 1, list_append(s, state), pos + list_position(st[pos + 1:], state), st FROM w CROSS JOIN al WHERE len < 3 AND list_contains(st[pos + 1:], state)),
f AS (SELECT s, count(*) AS c, count(*) / any_value(n) AS p FROM w, n GROUP BY s HAVING count(*) >= greatest(1, floor(0.1 * any_value(n))))"""
register("frequent_subsequences", f"WITH RECURSIVE {_T}, {_MINE} SELECT array_to_string(s, '>') AS subsequence, c AS support, round(p, 6) AS proportion FROM f")(
    lambda s, d: mining.frequent_subsequences(talks(s, d), 0.1, 3).select(F.array_join("subsequence", ">").alias("subsequence"), "support", r6("proportion"))
)
register(
    "association_rules",
    f"""WITH RECURSIVE {_T}, {_MINE}, k AS (SELECT s, p, unnest(range(1, len(s))) AS k FROM f WHERE len(s) > 1), r AS (SELECT k.s[1:k] AS a, k.s[k + 1:] AS b, p FROM k)
SELECT array_to_string(a, '>') AS antecedent, array_to_string(b, '>') AS consequent, round(r.p, 6) AS support, round(r.p / fa.p, 6) AS confidence, round(r.p / fa.p / fb.p, 6) AS lift, round(r.p - fa.p * fb.p, 6) AS leverage,
CASE WHEN r.p / fa.p >= 1 THEN CAST('inf' AS DOUBLE) ELSE round((1 - fb.p) / (1 - r.p / fa.p), 6) END AS conviction FROM r JOIN f fa ON fa.s = r.a JOIN f fb ON fb.s = r.b WHERE r.p / fa.p >= 0.2""",
)(
    lambda s, d: mining.association_rules(talks(s, d), 0.1, 0.2, 3).select(
        F.array_join("antecedent", ">").alias("antecedent"), F.array_join("consequent", ">").alias("consequent"), *(r6(c) for c in ("support", "confidence", "lift", "leverage", "conviction"))
    )
)


# --- round trips -----------------------------------------------------------------------------------


def _round_trip(save: Callable, load: Callable) -> Query:
    """A pool written to a new folder beside the checkpoints, and read again."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        path = f"{shared_dir(spark)}/round-trip-{uuid.uuid4().hex}"
        save(SequencePool(table(spark, d, "conversations").select("conv_id", "turn", "role"), TALKS), path)
        return load(spark, path, TALKS).data.select("conv_id", F.col("turn").cast("long").alias("turn"), "role")

    return query


for _kind, _save, _load in (("csv", save_csv, load_csv), ("json", save_json, load_json), ("parquet", save_parquet, load_parquet)):
    register(f"roundtrip_{_kind}", "SELECT conv_id, turn, role FROM conversations")(_round_trip(_save, _load))


# --- generators ------------------------------------------------------------------------------------

_DRAWN = "CAST('0x' || substr(md5('{seed}:' || id || ':' || {t}), 1, 13) AS BIGINT)"
_CHAIN = np.array([[0.5, 0.25, 0.125, 0.125], [0.125, 0.5, 0.25, 0.125], [0.25, 0.25, 0.25, 0.25], [0.0625, 0.0625, 0.125, 0.75]])
_LIMITS = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in row[:-1].tolist()) + "]" for row in np.cumsum(_CHAIN, axis=1)) + "]"
register(
    "markov_sequences",
    f"""WITH RECURSIVE m AS (SELECT id, CAST(0 AS BIGINT) AS time, CAST(floor({_DRAWN.format(seed=1, t=0)} / 4503599627370496.0 * 4) AS INT) AS code FROM range(1000) t(id)
UNION ALL SELECT id, time + 1, CAST(len(list_filter({_LIMITS}[code + 1], lambda x: x <= {_DRAWN.format(seed=1, t='(time + 1)')} / 4503599627370496.0)) AS INT) FROM m WHERE time < 19)
SELECT id, time, ['A', 'B', 'C', 'D'][code + 1] AS state FROM m""",
)(lambda s, d: generate_markov_sequences(s, 1000, 20, _CHAIN, seed=1).data)
register("simple_sequences", f"SELECT id, t AS time, ['A', 'B', 'C', 'D'][1 + {_DRAWN.format(seed=1, t='t')} % 4] AS state FROM range(1000) a(id), range(10) b(t)")(
    lambda s, d: generate_simple_sequences(s, 1000, 10, 4, seed=1).data
)
register("financial_journeys")(lambda s, d: generate_financial_journeys(s, 500, seed=1))
_ENDS = ("kyc_rejected", "closed_voluntary", "closed_involuntary")


@register("financial_journeys_law", "SELECT 500 AS n_ids, 0 AS n_repeated_times, 0 AS n_unknown, 0 AS n_outside, 0 AS n_not_from_lead, 0 AS n_after_the_end, 0 AS n_short_or_long, 0 AS n_unearned, true AS repeatable")
def financial_journeys_law(spark: SparkSession, d: str) -> DataFrame:
    """What holds of every simulated journey: counted breaches, and whether a seed gives the same rows again."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("time")
    rows = generate_financial_journeys(spark, 500, seed=1)
    categories = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    past = F.collect_set("state").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # A customer is active only once an account was opened.
    later = ~F.col("state").isin(*ONBOARDING_STATES)
    marked = rows.select(
        "id",
        "state",
        F.coalesce(F.try_element_at(categories, F.col("state")) != F.col("state_category"), F.lit(True)).alias("unknown"),
        ((F.year("date") != 2025) | (F.dayofyear("date") != F.col("time") + 1)).alias("outside"),
        ((F.row_number().over(w) == 1) & (F.col("state") != "lead")).alias("start"),
        (F.col("state").isin(*_ENDS) & F.lead("state").over(w).isNotNull()).alias("ended"),
        (later & ~F.array_contains(past, "account_opened")).alias("unearned"),
        (F.lag("time").over(w) == F.col("time")).alias("again"),
    )
    count = lambda c, name: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).cast("int").alias(name)
    per = marked.groupBy("id").agg(F.count("*").alias("n"), F.max(F.col("state").isin(*_ENDS)).alias("closed"))
    odd = per.agg(F.count("*").cast("int").alias("n_ids"), F.sum(((F.col("n") > 365) | (F.col("n") < 12) & ~F.col("closed")).cast("int")).cast("int").alias("n_short_or_long"))
    other = generate_financial_journeys(spark, 500, seed=1)
    same = rows.unionByName(other).groupBy("id", "time", "state").count().agg(F.bool_and(F.col("count") == 2).alias("repeatable"))
    counted = marked.agg(count("again", "n_repeated_times"), count("unknown", "n_unknown"), count("outside", "n_outside"), count("start", "n_not_from_lead"), count("ended", "n_after_the_end"), count("unearned", "n_unearned"))
    return counted.crossJoin(odd).crossJoin(same)  # one row each
