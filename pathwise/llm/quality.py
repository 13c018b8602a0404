"""Quality rules as weak supervision, in DataFrame expressions only.

Eight rules look at figures of a whole text; each votes good (1), bad (-1) or, between two bounds and
where its figure is undefined, abstains (0). The votes of all documents are counted by pattern, of which
there are at most 3**8; expectation-maximisation over that table estimates, for both latent classes, how
often each rule votes either way, and the share of good documents. A document's verdict is the posterior
probability of the good class, instead of a demand that all rules pass. Each kind of junk has two rules
that see it; the EM starts from "two bad votes are bad, one is in doubt" and so learns which rules' bad
votes are borne out by others. The length of a text is no vote: it would part short from long texts.

Defined results: a null text is the empty text, with no words and no good vote; rows may repeat and each
counts; an empty table gives no rows. A text is held in one task's heap, with some 60 bytes for each of
its words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathwise.llm.runtime import collect_bounded, materialise

RULES = ("symbols", "marked", "capitals", "lines", "repeats", "word_size", "shouts", "prose")
ROUNDS = 30
MIN_WORDS = 50
KEEP_PROBABILITY = 0.5
#: Probability of good before the first round, by the number of bad votes; the last holds for more.
START = (0.98, 0.4, 0.02)
#: Pseudo-votes that keep every estimated rate off 0 and 1.
PRIOR = 1.0


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text figures and n_lines, n_marked, n_capitals, n_shouts, n_stops of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda x: x != "")
    base = docs.select("doc_id", text.alias("text"), words.alias("w"))
    # Hash and place of each window of three words; after sorting, a window found twice stands beside its equal.
    window = F.when(
        F.size("w") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    base = base.withColumn("s", F.sort_array(window))
    twice = F.filter(F.col("s"), lambda x, k: (F.get("s", k - 1)["h"] == x["h"]) | (F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False))))
    base = base.withColumn("p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).cast("long").alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: x.rlike("[#*$%&|<>]"))).cast("long").alias("n_marked"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        (F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))).cast("long").alias("n_stops"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.coalesce(F.when(bad, -1).when(good, 1), F.lit(0)).cast("int")


def votes() -> dict[str, Column]:
    """Each rule's vote from the columns of features(); without words all abstain."""
    n = F.when(F.col("n_words") > 0, F.col("n_words"))
    share = lambda c: F.col(c) / n
    lines = F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines"))
    capitals = F.col("n_capitals") / F.when(F.col("word_chars") > 0, F.col("word_chars"))
    return {
        "symbols": _vote(share("n_symbols") > 0.3, share("n_symbols") < 0.1),
        "marked": _vote(share("n_marked") > 0.2, share("n_marked") < 0.1),
        "capitals": _vote(capitals > 0.4, capitals < 0.2),
        "lines": _vote(lines > 0.5, lines < 0.35),
        "repeats": _vote(share("n_repeat_words") > 0.3, share("n_repeat_words") < 0.15),
        "word_size": _vote((share("word_chars") < 2.5) | (share("word_chars") > 14), (share("word_chars") >= 3) & (share("word_chars") <= 12)),
        "shouts": _vote(share("n_shouts") > 0.3, share("n_shouts") < 0.1),
        "prose": _vote(share("n_stops") < 0.003, share("n_stops") > 0.01),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """EM over (votes, count): the log odds of good before any vote, and what each vote adds to them."""
    total = sum(n for _, n in patterns)
    if not total:
        return 0.0, [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in RULES]
    good = [START[min(v.count(-1), len(START) - 1)] for v, _ in patterns]
    for _ in range(rounds):
        mass = sum(g * n for g, (_, n) in zip(good, patterns, strict=True))
        share = (mass + PRIOR) / (total + 2 * PRIOR)
        odds, weights = math.log(share / (1 - share)), []
        for j in range(len(RULES)):
            w = {}
            for vote in (-1, 0, 1):
                g = sum(p * n for p, (v, n) in zip(good, patterns, strict=True) if v[j] == vote)
                b = sum((1 - p) * n for p, (v, n) in zip(good, patterns, strict=True) if v[j] == vote)
                w[vote] = math.log((g + PRIOR) / (mass + 3 * PRIOR)) - math.log((b + PRIOR) / (total - mass + 3 * PRIOR))
            # A rule is never worse than chance, and an abstention says nothing.
            weights.append({-1: min(w[-1], 0.0), 0: 0.0, 1: max(w[1], 0.0)})
        good = [1 / (1 + math.exp(-max(-50.0, min(50.0, odds + sum(w[x] for w, x in zip(weights, v, strict=True)))))) for v, _ in patterns]
    return odds, weights


def _verdict(odds: float, weights: list[dict[int, float]]) -> tuple[Column, Column, Column]:
    """base_failed, quality_probability and the predicate to keep a row, from figures and votes."""
    total = F.lit(odds)
    for rule, w in zip(RULES, weights, strict=True):
        total = total + F.when(F.col(f"v_{rule}") == -1, w[-1]).when(F.col(f"v_{rule}") == 1, w[1]).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return failed, 1 / (1 + F.exp(-total)), ~failed


def _voted(docs: DataFrame) -> DataFrame:
    return features(docs).withColumns({f"v_{k}": v for k, v in votes().items()})


def _fit(voted: DataFrame) -> tuple[float, list[dict[int, float]]]:
    names = [f"v_{k}" for k in RULES]
    table = collect_bounded(voted.groupBy(*names).count(), 3 ** len(RULES), "vote patterns")
    return fit(sorted((tuple(r[c] for c in names), r["count"]) for r in table))


def judge(docs: DataFrame, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """doc_id, the figures, base_failed, quality_probability and kept of every row."""
    seen = materialise(_voted(docs))
    failed, p, passed = _verdict(*_fit(seen))
    return seen.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (passed & (p >= keep_probability)).alias("kept"), p.alias("quality_probability")
    )


def keep(docs: DataFrame, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep.

    The figures are computed once: rows are written with their votes, so that each is judged, once all
    votes are counted, by a few integers beside it.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id")
    seen = materialise(_voted(docs.select(row, "text")))
    _, p, passed = _verdict(*_fit(seen))
    return seen.where(passed & (p >= keep_probability)).select("doc_id.*")


def oracle(rounds: int = ROUNDS, keep_probability: float = KEEP_PROBABILITY) -> str:
    """DuckDB SQL for judge() over ``documents``, without the probability; the EM is a recursion over one row."""
    k = range(1, len(RULES) + 1)
    rules = ", ".join(str(j) for j in k)
    share = lambda side, mark: f"list_sum(list_transform(range(1, len(vs) + 1), lambda i: CASE WHEN vs[i][j] = {mark} THEN {side} * ns[i] ELSE 0.0 END))"
    weight = lambda mark: f"ln(({share('g[i]', mark)} + {PRIOR}) / (mass + 3 * {PRIOR})) - ln(({share('(1 - g[i])', mark)} + {PRIOR}) / (total - mass + 3 * {PRIOR}))"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM dup) GROUP BY r),
l AS (SELECT d.*, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls FROM d),
f AS (SELECT l.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(w, lambda y: regexp_matches(y, '[#*$%&|<>]'))) AS marked, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS caps, length(x) - length(replace(x, '!', '')) AS shouts, length(x) - length(replace(x, '.', '')) AS stops
  FROM l LEFT JOIN rep ON rep.r = l.r),
q AS (SELECT *, n_symbols / nullif(n_words, 0) AS sy, marked / nullif(n_words, 0) AS mk, caps / nullif(word_chars, 0) AS ca, n_dup_lines / nullif(n_lines, 0) AS li, n_repeat_words / nullif(n_words, 0) AS re, word_chars / nullif(n_words, 0) AS ws, shouts / nullif(n_words, 0) AS sh, stops / nullif(n_words, 0) AS st FROM f),
v AS (SELECT *, [CASE WHEN sy > 0.3 THEN -1 WHEN sy < 0.1 THEN 1 ELSE 0 END, CASE WHEN mk > 0.2 THEN -1 WHEN mk < 0.1 THEN 1 ELSE 0 END, CASE WHEN ca > 0.4 THEN -1 WHEN ca < 0.2 THEN 1 ELSE 0 END,
  CASE WHEN li > 0.5 THEN -1 WHEN li < 0.35 THEN 1 ELSE 0 END, CASE WHEN re > 0.3 THEN -1 WHEN re < 0.15 THEN 1 ELSE 0 END, CASE WHEN ws < 2.5 OR ws > 14 THEN -1 WHEN ws >= 3 AND ws <= 12 THEN 1 ELSE 0 END,
  CASE WHEN sh > 0.3 THEN -1 WHEN sh < 0.1 THEN 1 ELSE 0 END, CASE WHEN st < 0.003 THEN -1 WHEN st > 0.01 THEN 1 ELSE 0 END] AS v FROM q),
s AS (SELECT list(v ORDER BY v) AS vs, list(n ORDER BY v) AS ns, CAST(sum(n) AS DOUBLE) AS total FROM (SELECT v, count(*) AS n FROM v GROUP BY v)),
em AS (SELECT 0 AS k, list_transform(vs, lambda y: CAST(CASE len(list_filter(y, lambda z: z = -1)) WHEN 0 THEN {START[0]} WHEN 1 THEN {START[1]} ELSE {START[2]} END AS DOUBLE)) AS g FROM s UNION ALL
  SELECT k + 1, list_transform(vs, lambda y: 1 / (1 + exp(-greatest(-50.0, least(50.0, odds + list_sum(list_transform([{rules}], lambda j: CASE y[j] WHEN -1 THEN bad[j] WHEN 1 THEN fine[j] ELSE 0.0 END))))))) FROM
  (SELECT k, vs, ln(((mass + {PRIOR}) / (total + 2 * {PRIOR})) / (1 - (mass + {PRIOR}) / (total + 2 * {PRIOR}))) AS odds,
    list_transform([{rules}], lambda j: least(0.0, {weight(-1)})) AS bad, list_transform([{rules}], lambda j: greatest(0.0, {weight(1)})) AS fine FROM
   (SELECT k, g, vs, ns, total, list_sum(list_transform(range(1, len(vs) + 1), lambda i: g[i] * ns[i])) AS mass FROM em, s WHERE k < {rounds}))),
p AS (SELECT unnest(vs) AS v, unnest(g) AS p FROM em, s WHERE k = {rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND p >= {keep_probability} AS kept FROM v JOIN p USING (v)
"""
