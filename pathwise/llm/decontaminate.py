"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised items become one automaton over word ids, built on the driver from a benchmark whose
size is measured first and shipped to every task. Training words are streamed through it; at each
position the longest suffix that occurs in some item is known. A suffix of ``window`` words or more
marks its words as hit; an item of fewer words is hit only as a whole. A benchmark above
``block_bytes`` is cut into blocks of whole items, each with its own automaton. Blocks are built, shipped
and passed one at a time; the hits of each are written for the rows that have any, and the last pass
merges them, so the driver and the tasks hold one block whatever the benchmark's size (and the driver
the next one's items). An item longer than a block is a block of its own.

Words are compared by 64-bit hashes. Defined results: a null text or item has no words; an item
without words never occurs; an item with a null id is not reported but its words are hit; items of
one id count once; rows may repeat, each is judged by itself; an empty benchmark or table gives no hits
or no rows. A text is held by one task, with some 40 bytes for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.runtime import materialise, neutral
from pathwise.llm.text import ALNUM, Texts, Words, slices

WINDOW = 10
BLOCK_BYTES = 1 << 20


class Automaton:
    """A generalised suffix automaton with the item ids of each state."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int) -> None:
        self.window = window
        self.length, self.link, self.next = [0], [-1], [{}]
        ends = []
        for key, words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            ends.append((key, path))
        self.items: list[set] = [set() for _ in self.length]
        self.short: list[list] = [[] for _ in self.length]
        self.has_short = any(0 < len(path) < window for _, path in ends)
        for key, path in ends:
            if 0 < len(path) < window:
                self.short[path[-1]].append((len(path), key))
            for s in path:
                while s > 0 and key not in self.items[s]:
                    self.items[s].add(key)
                    s = self.link[s]

    def _new(self, length: int, link: int, moves: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def match(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans [from, to) of a run of words, joined where they touch, and the items that occur."""
        s, n, spans, found = 0, 0, [], set()
        for i, w in enumerate(words):
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            else:
                s, n = 0, 0
            hit = 0
            if n >= self.window:
                t = s
                while self.length[self.link[t]] >= self.window:
                    t = self.link[t]
                found |= self.items[t]
                hit = n
            if self.has_short:
                t = s
                while t > 0:
                    for m, key in self.short[t]:
                        if m <= n:
                            hit = max(hit, m)
                            found.add(key)
                    t = self.link[t]
            if hit:
                a = i + 1 - hit
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, found


class Index:
    """What a task needs of a block of items: vocabulary, word pairs and the automaton."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        kept, hashes = [], []
        words = Words(texts := Texts(pa.array([t for _, t in items], pa.string())), ALNUM)
        h = words.hashes()
        for k in range(len(texts)):
            a, b = words.first[k], words.first[k + 1]
            if b > a:
                kept.append(items[k][0])
                hashes.append(h[a:b])
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        seqs = [np.searchsorted(self.vocabulary, x) for x in hashes]
        pairs = [s[:-1] * len(self.vocabulary) + s[1:] for s in seqs]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.shortest = min([window, *map(len, seqs)])
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.automaton = Automaton(list(zip(kept, (s.tolist() for s in seqs), strict=True)), window)

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe) and len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == h[maybe]
            out[maybe[same]] = at[same]
        return out

    def runs(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words, within a text, whose neighbours are all neighbours in some item."""
        known = ids >= 0
        if not known.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = np.zeros(len(ids), bool)  # word i and word i + 1
        joined[:-1] = known[:-1] & known[1:]
        heads = first[(first > 0) & (first < len(ids))]
        joined[heads - 1] = False
        at = np.flatnonzero(joined)
        if len(at):
            if len(self.pairs):
                key = ids[at] * len(self.vocabulary) + ids[at + 1]
                k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                joined[at[self.pairs[k] != key]] = False
            else:
                joined[at] = False
        before = np.concatenate([[False], joined[:-1]])
        a, b = np.flatnonzero(known & ~before), np.flatnonzero(known & ~joined) + 1
        long = b - a >= self.shortest
        return a[long], b[long]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Blocks of whole items, one after the other; at least one, which may be empty."""
    items = benchmark.select(F.col("item_id").cast("string").alias("k"), "text")
    block, size = [], 0
    for k, text in items.toLocalIterator():
        n = len((text or "").encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((k, text))
        size += n
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with hit_n_words, hit_spans (byte spans of hit words, flat) and hit_items.

    Columns of ``docs`` with those names are replaced.
    """
    docs = docs.drop("row_of_hit", "hit_n_words", "hit_words", "hit_spans", "hit_items")
    blocks, context = _blocks(benchmark, block_bytes), docs.sparkSession.sparkContext
    block, found = next(blocks), None
    for after in blocks:  # every block but the last
        if found is None:  # hits of several blocks meet by the number of their row, in a table that keeps it
            docs, found = materialise(docs.withColumn("row_of_hit", F.monotonically_increasing_id())), []
        shipped = context.broadcast(Index(block, window))
        hit = _pass(docs.select("row_of_hit", "text"), shipped, first=True).where(F.size("hit_words") > 0)
        found.append(materialise(hit.select("row_of_hit", "hit_words", "hit_items")))
        shipped.unpersist()
        block = after
    shipped = context.broadcast(Index(block, window))
    if found is None:
        return _pass(docs, shipped, first=True)
    rows = reduce(DataFrame.unionByName, found).groupBy("row_of_hit")
    rows = materialise(rows.agg(F.flatten(F.collect_list("hit_words")).alias("hit_words"), F.array_distinct(F.flatten(F.collect_list("hit_items"))).alias("hit_items")))
    none = [F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c) for c, kind in (("hit_words", "bigint"), ("hit_items", "string"))]
    own = [F.col(f"`{c}`") for c in docs.columns if c != "row_of_hit"]
    return _pass(docs.join(rows, "row_of_hit", "left").select(*own, *none), shipped, first=False)


def _pass(docs: DataFrame, shipped, first: bool) -> DataFrame:
    """A block's pass. hit_words are word positions, flat; unless it is the first, the hits that the rows have are merged in."""
    extra = "hit_n_words long, hit_words array<long>, hit_spans array<long>, hit_items array<string>"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if not f.name.startswith("hit_"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shipped.value
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = Texts(batch.column(batch.schema.get_field_index("text")))
                words = Words(texts, ALNUM)
                hit: dict[int, list] = {}
                if len(index.vocabulary):
                    ids = index.ids(words.hashes())
                    owner = None
                    for a, b in zip(*index.runs(ids, words.first), strict=True):
                        spans, found = index.automaton.match(ids[a:b].tolist())
                        if spans:
                            owner = words.first if owner is None else owner
                            k = int(np.searchsorted(owner, a, "right")) - 1
                            mine = hit.setdefault(k, [[], set()])
                            mine[0] += [(int(a) + x - int(words.first[k]), int(a) + y - int(words.first[k])) for x, y in spans]
                            mine[1] |= found
                spans, places, items = [], [], []
                old = None if first else [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hit_words", "hit_items")]
                for k in range(len(texts)):
                    got, found = hit.get(k, ((), ()))
                    if old is not None:
                        flat = old[0][k]
                        got = [*got, *zip(flat[::2], flat[1::2], strict=True)]
                        found = {*found, *old[1][k]}
                    got = _merged(got)
                    base, start = int(words.first[k]), int(texts.start[k])
                    places.append([x for s in got for x in s])
                    spans.append([x for a, b in got for x in (int(words.starts[base + a]) - start, int(words.ends[base + b - 1]) - start)])
                    items.append(sorted(x for x in found if x is not None))
                own = [c for c in batch.schema.names if not c.startswith("hit_")]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(words.counts, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    [*own, "hit_n_words", "hit_words", "hit_spans", "hit_items"],
                )

    return docs.mapInArrow(run, f"{kinds}, {extra}")


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_hit(column: str = "hit_words"):
    """Words in the flat spans: the ends less the starts."""
    return F.aggregate(F.transform(F.col(column), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    found = matches(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    return found.select(
        "doc_id",
        F.col("hit_n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with test passages cut out of their texts, under the same columns.

    A hit span of more than ``max_words`` words is removed from the text; a document of which more
    than ``max_coverage`` of the words are hit goes as a whole. Other texts stay byte for byte.
    """
    docs, back = neutral(docs, ("text",))
    columns = docs.columns
    found = matches(docs, benchmark, window).where((F.col("hit_n_words") == 0) | (n_hit() <= max_coverage * F.col("hit_n_words")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, places, spans = batch.column(at), batch.column(batch.schema.get_field_index("hit_words")), batch.column(batch.schema.get_field_index("hit_spans"))
            if pc.max(pc.list_value_length(spans)).as_py():
                out = texts.to_pylist()
                for k, (w, s) in enumerate(zip(places.to_pylist(), spans.to_pylist(), strict=True)):
                    if cuts := [(s[i], s[i + 1]) for i in range(0, len(s), 2) if w[i + 1] - w[i] > max_words]:
                        raw, parts, done = out[k].encode(), [], 0
                        for a, b in cuts:
                            parts.append(raw[done:a])
                            done = b
                        out[k] = b"".join([*parts, raw[done:]]).decode()
                texts = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in columns], columns)

    return found.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)).select(*back)


#: DuckDB SQL for report() over ``documents`` and ``benchmark``.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
seen AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, item_id, i, n FROM seen JOIN win USING (k, n)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)
"""
