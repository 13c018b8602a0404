"""URL filters as a temporal list join.

A list is a log of dated entries: on a day, a key (a host, a domain with its subdomains, or a host with a
path prefix) is added to or removed from it. The log is folded to validity intervals [start, stop), and
each capture is evaluated against the entries that were active on the day it was fetched.

A list key's log is first reduced to its last action of each day, so a hot key has at most one row for
each day of the calendar. Captures are evaluated once for each distinct URL and day, and their keys asked
about once for each day: those questions, of which a hot key has at most as many as there are days, meet
the intervals, cut at month borders, in an equi-join on key and month. Only keys with an answer go back
to the captures that asked.

Defined results: a null or host-less URL, or a null day, matches nothing; host names are compared in
lower case; of several matches the longest key decides, then a block over an allow, then the list's
name; on one day a removal beats an addition; entries with a null key, list or day are void; rows may
repeat; empty tables match nothing. A URL of n path parts or labels has n keys, whose total length grows with
the square of its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwise.llm.runtime import materialise

VERDICT = ("n_active", "verdict", "decided_by", "list_name")


def host(url: Column) -> Column:
    """The lower-case host of a URL, without user and port; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def path(url: Column) -> Column:
    """The path of a URL, from its first slash."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)


def keys(url: Column) -> Column:
    """All list keys a URL can match: its host, the domains above it, and its path prefixes."""
    h, labels = host(url), F.split(host(url), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, n), ".")))
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("prefix:"), h, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.concat(F.array(F.concat(F.lit("host:"), h)), F.when(n > 1, domains).otherwise(F.array().cast("array<string>")), F.coalesce(prefixes, F.array().cast("array<string>")))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, action, key, start, stop) from a log (list, action, key, op, day); op is add or remove, an open interval's stop is null."""
    rows = entries.where("list is not null and key is not null and day is not null")
    daily = rows.groupBy("list", "action", "key", "day").agg(F.min(F.when(F.col("op") == "add", 1).otherwise(0)).alias("on"))
    w = Window.partitionBy("list", "action", "key").orderBy("day")
    spans = daily.withColumn("stop", F.lead("day").over(w))
    return spans.where("on = 1").select("list", "action", "key", F.col("day").alias("start"), "stop")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """``captures`` with n_active (active entries), verdict (block, allow or none), decided_by and list_name.

    Columns of ``captures`` with those four names are replaced, any other name is kept.
    """
    own = [c for c in captures.columns if c not in VERDICT]
    captures = captures.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)), F.col(f"`{url}`").alias("u"), F.col(f"`{day}`").alias("d"))
    fetched = materialise(captures.select("u", "d").where(host(F.col("u")).isNotNull() & F.col("d").isNotNull()).distinct())
    asked = fetched.select("u", "d", F.explode(F.array_distinct(keys(F.col("u")))).alias("key"))
    # Only the months in which anything was fetched matter: two dates bound the cut intervals.
    valid = intervals(entries).crossJoin(F.broadcast(fetched.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))))
    valid = valid.select("list", "action", "key", F.greatest("start", "lo").alias("start"), F.least(F.coalesce("stop", F.date_add("hi", 1)), F.date_add("hi", 1)).alias("stop")).where("start < stop")
    month = F.sequence(F.trunc("start", "month"), F.trunc(F.date_sub("stop", 1), "month"), F.expr("interval 1 month"))
    valid = valid.select("list", "action", "key", "start", "stop", F.explode(month).alias("month"))
    # A key is asked about once for each day, merged before the shuffle, however many captures ask.
    questions = asked.select("key", "d").distinct().withColumn("month", F.trunc("d", "month"))
    hits = questions.join(valid, ["key", "month"]).where("start <= d and d < stop")
    answers = materialise(hits.groupBy("key", "d").agg(F.count("*").alias("n"), F.max(F.struct((F.col("action") == "block").cast("int").alias("b"), "list")).alias("best")))
    # Absent keys end here. Spark can split a hot key, and below a hot URL: one side is a materialised row for each key.
    best = F.max(F.struct(F.length("key").alias("n"), F.col("best.b").alias("b"), F.col("key").alias("key"), F.col("best.list").alias("list")))
    found = asked.join(answers, ["key", "d"]).groupBy("u", "d").agg(F.sum("n").alias("n"), best.alias("best"))
    found = materialise(found.select("u", "d", "n", F.when(F.col("best.b") == 1, "block").otherwise("allow").alias("v"), F.col("best.key").alias("k"), F.col("best.list").alias("l")))
    out = captures.join(found, ["u", "d"], "left")
    return out.select(
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(own)),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("v", F.lit("none")).alias("verdict"),
        F.coalesce("k", F.lit("")).alias("decided_by"),
        F.coalesce("l", F.lit("")).alias("list_name"),
    )


def synthetic_log(pages: DataFrame) -> DataFrame:
    """A list log for the test tables, which have none: every third page lists its host, domain or first directory."""
    i, u = F.col("page_id"), F.col("url")
    h = host(u)
    first = F.filter(F.split(path(u), "/"), lambda x: x != "")
    kind = i % 9
    key = (
        F.when(kind == 0, F.concat(F.lit("host:"), h))
        .when(kind == 3, F.concat(F.lit("domain:"), F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)))
        .otherwise(F.concat(F.lit("prefix:"), h, F.lit("/"), F.get(first, 0)))
    )
    return pages.where(i % 3 == 0).select(
        F.concat(F.lit("list"), (i % 2).cast("string")).alias("list"),
        F.when(i % 5 == 1, "allow").otherwise("block").alias("action"),
        key.alias("key"),
        F.when(i % 4 == 1, "remove").otherwise("add").alias("op"),
        _day(i * 13 % 730).alias("day"),
    )


def _day(offset: Column) -> Column:
    return F.date_add(F.to_date(F.lit("2023-01-01")), offset.cast("int"))


def report(pages: DataFrame) -> DataFrame:
    """page_id, day, n_active, verdict, decided_by and list_name of every page, fetched on a day set by its id."""
    captures = pages.select("page_id", "url", _day(F.col("page_id") * 37 % 730).alias("day"))
    return evaluate(captures, synthetic_log(pages.select("page_id", "url"))).select("page_id", F.col("day").cast("string").alias("day"), "n_active", "verdict", "decided_by", "list_name")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, DATE '2023-01-01' + CAST(page_id * 37 % 730 AS INT) AS d, DATE '2023-01-01' + CAST(page_id * 13 % 730 AS INT) AS listed,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
e AS (
  SELECT 'list' || (page_id % 2) AS l, CASE WHEN page_id % 5 = 1 THEN 'allow' ELSE 'block' END AS action,
    CASE page_id % 9 WHEN 0 THEN 'host:' || h WHEN 3 THEN 'domain:' || regexp_extract(h, '([^.]+\.[^.]+)$', 1) ELSE 'prefix:' || h || '/' || parts[1] END AS key,
    CASE WHEN page_id % 4 = 1 THEN 0 ELSE 1 END AS is_on, listed AS day
  FROM p WHERE page_id % 3 = 0),
daily AS (SELECT l, action, key, day, min(is_on) AS is_on FROM e WHERE key IS NOT NULL GROUP BY ALL),
iv AS (SELECT l, action, key, is_on, day AS a, coalesce(lead(day) OVER (PARTITION BY l, action, key ORDER BY day), DATE '2100-01-01') AS b FROM daily),
k AS (
  SELECT page_id, d, 'host:' || h AS key FROM p WHERE h <> ''
  UNION SELECT page_id, d, 'domain:' || array_to_string(string_split(h, '.')[i:], '.') FROM (SELECT *, unnest(range(1, len(string_split(h, '.')))) AS i FROM p WHERE h <> '')
  UNION SELECT page_id, d, 'prefix:' || h || '/' || array_to_string(parts[1:i], '/') FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p WHERE h <> '')),
hit AS (SELECT page_id, l, action, key, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, action = 'block' DESC, key DESC, l DESC) AS r, count(*) OVER (PARTITION BY page_id) AS n
  FROM k JOIN iv USING (key) WHERE is_on = 1 AND a <= d AND d < b)
SELECT p.page_id, CAST(d AS VARCHAR) AS day, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(action, 'none') AS verdict, coalesce(key, '') AS decided_by, coalesce(l, '') AS list_name
FROM p LEFT JOIN hit ON p.page_id = hit.page_id AND r = 1
"""
