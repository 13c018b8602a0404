"""Secret scans over an incremental blob ledger, in DataFrame expressions only.

Every version of a text is addressed by its SHA-256. The ledger has a row for each scan of a blob: the
blob, the rules it was scanned with, as "name@version", and the spans found, each with the name and version
of its rule. A scan asks the ledger for the distinct hashes first; patterns are run only on texts of blobs,
and with rules, that it lacks. Findings of the current rules, whatever their places in the list, are read
from the ledger and joined back to every path that holds the blob; those of removed rules and of former
versions stay in the ledger and are not reported.

Where a text stands, one pattern of the wanted rules screens it; only texts it lets through are shuffled
with their blob and scanned for spans, all others enter the ledger as scanned without a finding. Up to
``ASKED`` unseen blobs are broadcast to the texts, more are joined by a shuffle of the texts.

Matches have no offsets in SQL, so they are rebuilt: the pieces between matches come from splitting by
the same pattern, and a running sum over pieces and matches gives each start. Copies of a hot text are
merged before the shuffle; the join back has materialised findings at one side, so Spark can split the
paths of a hot blob.

Defined results: a null text is the empty text, with no finding; rows may repeat and each gets its
findings; two kinds may overlap; a ledger may hold a scan twice; an empty table gives no rows. A text of n
characters with m matches takes n plus some 100 * m bytes in one task; a longer one than 2 GB is no
string of Spark's.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwise.llm.runtime import materialise, neutral

MARK = "[SECRET]"


class Rule(NamedTuple):
    name: str
    version: int
    pattern: str
    value_group: int = 0
    min_value: int = 0
    base: bool = True


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: A private key to its END line or, where that is missing, to the end of its base64 lines. Line ends may be escaped or blanks.
_EOL = r"(?:[\x20\t\r\n]|\\[rn])+"
_PEM = (
    rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:{_EOL}(?:Proc-Type|DEK-Info):[A-Za-z0-9,\x20-]*){{0,4}}"
    rf"(?:[A-Za-z0-9+/=\x20\t\r\n\\]*-----END [A-Z ]{{0,40}}PRIVATE KEY-----|(?:(?:{_EOL}[A-Za-z0-9+/=]{{16,}})+(?:\r?\n[A-Za-z0-9+/=]{{1,15}})?)?)"
)
#: The base kinds, and those the method adds.
RULES = (
    Rule("assign", 1, rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 2, _PEM, base=False),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
)
_SPANS = "array<struct<start:int,end:int,rule:string,version:int>>"
#: Unseen blobs whose hashes and wanted rules are broadcast, at 100 bytes or so each.
ASKED = 200_000


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _stamp(rule: Rule) -> str:
    return f"{rule.name}@{rule.version}"


def _stamps(rules: tuple[Rule, ...]) -> Column:
    return F.array(*(F.lit(_stamp(r)) for r in rules)).cast("array<string>")


def _any(rules: tuple[Rule, ...]) -> Column:
    """Whether any rule matches in the text."""
    return F.coalesce(F.col("text").rlike("|".join(f"(?:{r.pattern})" for r in rules)), F.lit(False)) if rules else F.lit(False)


def _found(kind: int, rule: Rule, wanted: Column) -> Column:
    """The matches of a rule in order: kind, place, length of the piece before, own length, accepted."""
    zipped = F.arrays_zip(
        F.transform(F.split("text", rule.pattern), F.length).alias("gap"),
        F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)), F.length).alias("len"),
        F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.value_group)), F.length).alias("val"),
    )
    rows = F.transform(zipped, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), z["gap"].alias("gap"), z["len"].alias("len"), (z["val"] >= rule.min_value).alias("ok")))
    return F.when(wanted & F.col("text").rlike(rule.pattern), rows).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,ok:boolean>>"))


def pending(texts: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, pending): the distinct blobs of ``texts`` and the rule versions the ledger has not seen them with; by hash alone."""
    blobs = texts.select(blob_of(F.col("text")).alias("blob")).distinct()
    seen = ledger.select("blob", F.explode("scanned").alias("stamp")).groupBy("blob").agg(F.collect_set("stamp").alias("seen"))
    lacks = F.array_except(_stamps(rules), F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", lacks.alias("pending")).where(F.size("pending") > 0)


def scan(texts: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, scanned, spans) for what ``texts`` has and ``ledger`` lacks. spans are in order of start, then rule."""
    todo = texts.select(blob_of(F.col("text")).alias("blob"), "text")
    if ledger is None:
        todo, wanted = todo.withColumn("pending", _stamps(rules)), _any(rules)
    else:
        asked = materialise(pending(texts, ledger, rules))
        few = asked.limit(ASKED + 1).count() <= ASKED
        todo = todo.join(F.broadcast(asked) if few else asked, "blob")
        each = [F.array_contains("pending", _stamp(r)) & _any((r,)) for r in rules]
        wanted = F.when(F.size("pending") == len(rules), _any(rules)).otherwise(reduce(or_, each, F.lit(False)))
    blobs = todo.select("blob", "pending", F.when(wanted, F.col("text")).alias("text")).groupBy("blob", "pending").agg(F.any_value("text").alias("text"))
    nothing = F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,ok:boolean>>")
    matches = F.concat(nothing, *(_found(k, r, F.array_contains("pending", _stamp(r))) for k, r in enumerate(rules)))
    each = blobs.select("blob", "pending", F.explode_outer(F.filter(matches, lambda m: m["len"].isNotNull())).alias("m")).select("blob", "pending", "m.*")
    # The blob's partitioning holds for the window and the aggregate: no further shuffle.
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("blob", "pending", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    span = F.when(F.col("ok"), F.struct((end - F.col("len")).alias("start"), "kind", end.alias("end")))
    found = each.select("blob", "pending", span.alias("span")).groupBy("blob", "pending").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    names, versions = F.array(*(F.lit(r.name) for r in rules)), F.array(*(F.lit(r.version) for r in rules))
    named = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("rule"), F.get(versions, s["kind"]).alias("version")))
    return found.select("blob", F.col("pending").alias("scanned"), named.cast(_SPANS).alias("spans"))


def extend(texts: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with the new rows; what it had is kept as it is."""
    new = scan(texts, ledger, rules)
    return new if ledger is None else ledger.unionByName(new)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and the spans (start, kind, end) of ``rules`` in these versions, for blobs that have any; kind is the place in ``rules``."""
    kind = lambda s: (F.array_position(_stamps(rules), F.concat_ws("@", s["rule"], s["version"])) - 1).cast("int")
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), kind(s).alias("kind"), s["end"].alias("end")))
    rows = ledger.select("blob", F.filter(spans, lambda s: s["kind"] >= 0).alias("spans")).where(F.size("spans") > 0)
    return rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.name) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 and spans of every row; what ``ledger`` has is not scanned again."""
    found = findings(extend(docs.select("text"), ledger, rules), rules)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{r.name}") for k, r in enumerate(rules) if r.base]
    based = F.array(*(F.lit(r.base) for r in rules))
    base = _joined(F.filter("spans", lambda s: F.get(based, s["kind"])), rules)
    found = materialise(found.select("blob", *counts, F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans"), rules).alias("spans")))
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    zero = [F.coalesce(f"n_{r.name}", F.lit(0).cast("long")).alias(f"n_{r.name}") for r in rules if r.base]
    return paths.join(found, "blob", "left").select("doc_id", *zero, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = MARK, ledger: DataFrame | None = None) -> DataFrame:
    """``docs``, same columns, with every found span replaced by ``mark``; overlapping spans give one.

    Without a ledger only texts in which a pattern occurs are shuffled and the others pass as they are;
    with one its findings decide, and no pattern is run on a blob that it has seen with all rules.
    """
    docs, back = neutral(docs, ("text",))
    columns = docs.columns
    suspects = docs.where(_any(rules)) if ledger is None else docs
    found = findings(extend(suspects.select("text"), ledger, rules), rules)
    # The end of the text covered before a span, so that pieces between spans are cut in one pass.
    each = found.select(F.col("blob").alias("_blob"), F.explode("spans").alias("s")).select("_blob", "s.*")
    before = Window.partitionBy("_blob").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("cut", F.coalesce(F.max("end").over(before), F.lit(0)))
    found = materialise(each.groupBy("_blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "cut"))).alias("_spans")))
    hit = suspects.withColumn("_blob", blob_of(F.col("text"))).join(found, "_blob", "left")
    one = F.lit(1)
    pieces = F.transform(
        "_spans",
        lambda s: F.concat(
            F.col("text").substr(s["cut"] + one, F.greatest(s["start"] - s["cut"], F.lit(0))),
            F.when(s["start"] >= s["cut"], mark).otherwise(""),
        ),
    )
    tail = F.array_max(F.transform("_spans", lambda s: s["end"]))
    cut = F.concat(F.array_join(pieces, ""), F.col("text").substr(tail + one, F.length("text")))
    kept = [F.coalesce(cut, F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in columns]
    hit = hit.select(*kept)
    return (docs.where(~_any(rules)).unionByName(hit) if ledger is None else hit).select(*back)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for report() over ``documents``."""
    parts = []
    for k, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT r, {k} AS kind, '{r.name}' AS name, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM ("
            f"SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.value_group}) AS v, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}'))"
        )
    least = " ".join(f"WHEN {k} THEN {r.min_value}" for k, r in enumerate(rules))
    counts = ", ".join(f"CAST(count(*) FILTER (kind = {k}) AS BIGINT) AS n_{r.name}" for k, r in enumerate(rules) if r.base)
    base = ", ".join(str(k) for k, r in enumerate(rules) if r.base)
    zero = ", ".join(f"coalesce(n_{r.name}, 0) AS n_{r.name}" for r in rules if r.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
s AS (SELECT r, kind, name, length(m[i]) AS n,
        CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a
      FROM f WHERE length(v[i]) >= CASE kind {least} END),
j AS (SELECT r, {counts},
        sha256(coalesce(string_agg(name || ':' || a || ':' || (a + n), ',' ORDER BY a, kind) FILTER (kind IN ({base})), '')) AS base_sha256,
        string_agg(name || ':' || a || ':' || (a + n), ',' ORDER BY a, kind) AS spans
      FROM s GROUP BY r)
SELECT doc_id, {zero}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (r)
"""
