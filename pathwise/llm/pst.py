"""Language-model scores from a probabilistic suffix tree over bytes.

A text is the sequence of its words, A-Z lowered, each word spelled in bytes, with a blank between words
and an end symbol behind the last. The tree holds contexts of up to ``DEPTH`` symbols. A context is a
candidate if it occurs ``MIN_COUNT`` times, at every size of the corpus; it is retained if its next-symbol
distribution diverges from its parent's (count times Kullback-Leibler divergence above
``MIN_DIVERGENCE``), or if a retained context ends in it. Distributions are smoothed towards the parent's,
the root's towards the uniform one. A symbol is scored in the state of the longest retained suffix of
what precedes it, end symbols before a text's start. Each state's distribution sums to one, and so do
the probabilities of all texts.

Counting: each task counts spelled contexts and words of its own texts with sorted arrays and sends sums.
Growing: the suffix of HEAD_DEPTH + 1 symbols deals the contexts to groups, whose subtrees grow apart on
the cluster; a partition holds the distinct contexts of its groups. Only retained contexts leave it, with
their seen symbols, in blocks of ``BLOCK`` rows. A block is gathered and broadcast; where the tree has several,
the texts pass once for each, and a symbol is scored by the block of its group.

The words' counts stay a distributed table. Words that make up ``HEAD_SHARE`` of all tokens, at most
1 / HEAD_SHARE, are broadcast; the other words of the texts are joined with the table, and as no such
word is frequent, no key of that join is hot.

Defined results: a null text is the empty text and has the end alone; a null id is held out, as the CRC
of the empty string is 0; repeated rows count and are scored each; without training rows every
distribution is uniform; an empty table gives no rows. A text is held by one task, with some 150 bytes
for each of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.runtime import materialise
from pathwise.llm.text import LOWER, NONSPACE, SPACE, Texts, Words, slices

DEPTH = 5
MIN_COUNT = 10
MIN_DIVERGENCE = 2.0
#: Pseudo-count of the parent's distribution for each distinct next symbol.
STRENGTH = 2.0
HEAD_SHARE = 1e-6
#: Half of the words, and a quarter of the contexts, that a task sums up before it sends them.
FLUSH = 1 << 19
#: Contexts of up to this depth are in every block; one symbol more makes a group, whose subtree is in one block.
HEAD_DEPTH = 2
#: Rows of the tree that are gathered and broadcast at once.
BLOCK = 6_000_000

END, BLANK, CONTROL = 0, 1, 2


def _codes() -> tuple[np.ndarray, int]:
    """Symbols of lowered bytes: printable ASCII and the bytes of UTF-8 each have one, controls share one."""
    code, n = np.full(256, CONTROL, np.int64), 3
    for b in [*range(33, 65), *range(91, 127), *range(0x80, 0xC0), *range(0xC2, 0xF5)]:
        code[b] = n
        n += 1
    code[SPACE] = BLANK
    return code, n


CODE, SYMBOLS = _codes()
NODE = SYMBOLS ** (DEPTH + 1)
_CONTROLS = int((CODE[:128] == CONTROL).sum()) - 26  # A-Z are lowered first


class Stream:
    """The symbols of some texts with their contexts; first[k] is the first symbol of text k."""

    def __init__(self, texts: Texts) -> None:
        lower = LOWER[texts.buf]
        space = SPACE[lower]
        keep = ~space
        keep[1:] |= ~space[:-1]
        bare = np.add.reduceat(keep, texts.start[:-1]) == 0 if len(texts) else np.zeros(0, bool)
        keep[texts.start[1:][bare] - 1] = True
        at = np.flatnonzero(keep)
        self.first = np.searchsorted(at, texts.start)
        self.symbols = CODE[lower[at]]
        self.symbols[self.first[1:] - 1] = END
        self.controls = (self.symbols == CONTROL).any()

    def context(self, j: int) -> np.ndarray:
        """The symbol j places before each; the end symbol before a text's start."""
        out = np.zeros(len(self.symbols), np.int64)
        out[j:] = self.symbols[:-j]
        for k in range(j):
            heads = self.first[:-1] + k
            out[heads[heads < np.minimum(self.first[1:], len(out))]] = END
        return out

    def grams(self, depth: int) -> np.ndarray:
        code = np.zeros(len(self.symbols), np.int64)
        for j in range(depth, 0, -1):
            code += self.context(j)
            code *= SYMBOLS
        return code + self.symbols


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(counts, edge) if len(keys) else counts


def _count(batches: Iterable[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Sums of words and spelled contexts of a partition, sent whenever FLUSH of either are held."""
    words: dict[bytes, int] = {}
    held, size = [], 0

    def send_words() -> Iterator[pa.RecordBatch]:
        keys = pa.array(list(words), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([keys, pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["w", "g", "n"])
        words.clear()

    def send_grams() -> Iterator[pa.RecordBatch]:
        keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        held[:] = [(keys, counts)]
        if len(keys) > FLUSH // 2:
            held.clear()
            for a in range(0, len(keys), 100_000):
                k, c = keys[a : a + 100_000], counts[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.string()), pa.array(k), pa.array(c)], ["w", "g", "n"])

    for whole in batches:
        for batch in slices(whole, "text"):
            texts = Texts(batch.column(batch.schema.get_field_index("text")))
            found = Words(texts, NONSPACE)
            _, at, n = np.unique(found.hashes(), return_index=True, return_counts=True)
            low = found.lower.tobytes()
            for a, b, k in zip(found.starts[at].tolist(), found.ends[at].tolist(), n.tolist(), strict=True):
                w = low[a:b]
                words[w] = words.get(w, 0) + k
            words[b""] = words.get(b"", 0) + len(texts)
            keys, counts = np.unique(Stream(texts).grams(depth), return_counts=True)
            held.append((keys, counts))
            size += len(keys)
            if len(words) > FLUSH // 2:
                yield from send_words()
            if size > 4 * FLUSH:
                yield from send_grams()
                size = sum(len(k) for k, _ in held)
    if words:
        yield from send_words()
    if held:
        keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        for a in range(0, len(keys), 100_000):
            k, c = keys[a : a + 100_000], counts[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.string()), pa.array(k), pa.array(c)], ["w", "g", "n"])


Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _level(grams: np.ndarray, counts: np.ndarray, parent: tuple[np.ndarray, np.ndarray], depth: int, min_count: float) -> Level:
    """Candidates of a depth from all its grams, sorted: grams and probabilities, contexts, parent's weights, divergences."""
    edge = np.flatnonzero(np.diff(grams // SYMBOLS, prepend=-1))
    if not len(edge):
        return grams, np.zeros(0), grams, np.zeros(0), np.zeros(0)
    total, size = np.add.reduceat(counts, edge), np.diff(np.append(edge, len(grams)))
    kept = np.repeat(total >= min_count, size)
    grams, counts, size, total = grams[kept], counts[kept], size[total >= min_count], total[total >= min_count]
    if not len(grams):
        return grams, np.zeros(0), grams, np.zeros(0), np.zeros(0)
    edge = np.cumsum(size) - size
    up = parent[1][np.searchsorted(parent[0], grams % SYMBOLS**depth)]  # a candidate's suffix is one too
    weight = STRENGTH * size
    p = (counts + np.repeat(weight, size) * up) / np.repeat(total + weight, size)
    share = weight / (total + weight)
    unseen = np.maximum(0.0, 1.0 - np.add.reduceat(up, edge))
    gain = total * (np.add.reduceat(p * np.log(p / up), edge) + share * np.log(share) * unseen)
    return grams, p, grams[edge] // SYMBOLS, share, gain


def _levels(grams: np.ndarray, counts: np.ndarray, depths: range, parent: tuple[np.ndarray, np.ndarray], min_count: float) -> list[Level]:
    out = []
    for d in depths:
        out.append(_level(*_summed(grams % SYMBOLS ** (d + 1), counts), parent, d, min_count))
        parent = out[-1][:2]
    return out


def _retained(levels: list[Level], depths: range, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and entries of the retained contexts; ``below`` has the retained contexts one deeper than the levels."""
    nodes, shares, keys, values = [], [], [], []
    for d, (grams, p, ctx, share, gain) in zip(reversed(depths), reversed(levels), strict=True):
        strong = gain >= MIN_DIVERGENCE
        strong[np.searchsorted(ctx, below % SYMBOLS**d)] = True
        below = ctx[strong]
        kept = np.isin(grams // SYMBOLS, below)
        nodes.append(d * NODE + below)
        shares.append(np.log10(share[strong]))
        keys.append(d * NODE + grams[kept])
        values.append(np.log10(p[kept]))
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((nodes, np.int64), (shares, float), (keys, np.int64), (values, float)))


class Tree:
    """A tree, or a block of one: the subtrees of some groups, with the contexts shorter than a group.

    A node or entry is its depth times NODE plus its context or gram; an entry has log10 of a seen symbol's
    probability, a node that of its parent's share, which every unseen symbol takes. Entries of depth 0 are the root's.
    """

    def __init__(self, depth: int, nodes: np.ndarray, shares: np.ndarray, keys: np.ndarray, values: np.ndarray, groups: tuple[int, int] | None = None) -> None:
        """groups: the first and last of the block; None takes all."""
        self.depth, self.groups = depth, groups
        order = np.argsort(nodes)
        self.nodes, self.shares = nodes[order], shares[order].astype(np.float32)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

    def _depth(self, grams: np.ndarray) -> np.ndarray:
        """The depth of the longest retained suffix of each gram's context."""
        depth, open_ = np.zeros(len(grams), np.int64), np.arange(len(grams))
        for d in range(1, self.depth + 1):
            open_ = open_[self._find(self.nodes, d * NODE + grams[open_] // SYMBOLS % SYMBOLS**d)[1]]
            depth[open_] = d
        return depth

    def _value(self, grams: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """log10 probability of the grams' symbols in the states of that depth."""
        out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        for d in range(self.depth, -1, -1):
            at = np.flatnonzero(open_ & (depth >= d))
            i, seen = self._find(self.keys, d * NODE + grams[at] % SYMBOLS ** (d + 1))
            out[at[seen]] += self.values[i[seen]]
            open_[at[seen]] = False
            if d and not seen.all():
                at = at[~seen]
                out[at] += self.shares[self._find(self.nodes, d * NODE + grams[at] // SYMBOLS % SYMBOLS**d)[0]]
        return out

    @property
    def _states(self) -> tuple[np.ndarray, np.ndarray]:
        return np.append(0, self.nodes // NODE), np.append(0, self.nodes % NODE)

    @cached_property
    def logp(self) -> np.ndarray:
        """[s, c]: log10 probability of the symbol c in state s, the root first; dense, for small trees."""
        depth, ctx = (np.repeat(x, SYMBOLS) for x in self._states)
        return self._value(ctx * SYMBOLS + np.tile(np.arange(SYMBOLS), len(self.nodes) + 1), depth).reshape(-1, SYMBOLS).astype(np.float32)

    @cached_property
    def child(self) -> np.ndarray:
        """[s, c]: the state of the context c before that of s, or 0; dense, for small trees."""
        depth, ctx = (np.repeat(x, SYMBOLS) for x in self._states)
        older = np.tile(np.arange(SYMBOLS), len(self.nodes) + 1)
        at, found = self._find(self.nodes, (depth + 1) * NODE + older * SYMBOLS**depth + ctx)
        return np.where(found, at + 1, 0).reshape(-1, SYMBOLS).astype(np.int32)

    def symbols(self, stream: Stream) -> np.ndarray:
        """log10 probability of each symbol; 0 where another block has its group."""
        grams, back = np.unique(stream.grams(max(self.depth, HEAD_DEPTH + 1)), return_inverse=True)
        out = self._value(grams, self._depth(grams))
        if stream.controls:
            out[grams % SYMBOLS == CONTROL] -= math.log10(_CONTROLS)
        if self.groups is not None:
            group = grams // SYMBOLS % SYMBOLS ** (HEAD_DEPTH + 1)
            out[(group < self.groups[0]) | (group > self.groups[1])] = 0.0
        return out[back]

    def score(self, stream: Stream) -> np.ndarray:
        """log10 probability of each text by the tree alone."""
        return np.add.reduceat(self.symbols(stream), stream.first[:-1])


def _subtrees(batches: Iterable[pa.RecordBatch], shipped, depths: range, min_count: float) -> Iterator[pa.RecordBatch]:
    """Retained nodes (negative) and entries of the groups of a partition, which has all grams of each."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    grams, counts = np.concatenate([g for g, _ in held]), np.concatenate([n for _, n in held])
    nodes, shares, keys, values = _retained(_levels(grams, counts, depths, shipped.value, min_count), depths, np.zeros(0, np.int64))
    groups = np.concatenate([nodes % NODE, keys % NODE // SYMBOLS]) % SYMBOLS ** depths[0]
    rows, values = np.concatenate([-nodes, keys]), np.concatenate([shares, values]).astype(np.float32)
    for a in range(0, len(rows), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (groups, rows, values)], ["grp", "k", "v"])


def trees(grams: DataFrame, depth: int = DEPTH, min_count: float = MIN_COUNT) -> Iterator[Tree]:
    """The blocks of the tree of the spelled contexts (g, n), of BLOCK rows or a single group each."""
    spark, cut = grams.sparkSession, min(depth, HEAD_DEPTH)
    got = grams.groupBy(F.expr(f"g % {SYMBOLS ** (cut + 1)}L").alias("g")).agg(F.sum("n").alias("n")).toArrow()
    short, counts = got["g"].to_numpy(), got["n"].to_numpy()
    root = np.bincount(short % SYMBOLS, counts, SYMBOLS)
    root = (root + 0.5) / (root.sum() + 0.5 * SYMBOLS)
    head = _levels(short, counts, range(1, cut + 1), (np.arange(SYMBOLS), root), min_count)
    sizes, table = [], None
    if depth > cut and len(short):
        depths, shipped = range(cut + 1, depth + 1), spark.sparkContext.broadcast(head[-1][:2])
        group = F.expr(f"g div {SYMBOLS} % {SYMBOLS ** (cut + 1)}L")
        dealt = grams.select("g", "n").repartition(group)
        table = materialise(dealt.mapInArrow(lambda b: _subtrees(b, shipped, depths, min_count), "grp long, k long, v float"))
        sizes = table.groupBy("grp").count().orderBy("grp").collect()
    nodes, shares, keys, values = _retained(head, range(1, cut + 1), np.array([r["grp"] for r in sizes], np.int64))
    keys, values = np.concatenate([np.arange(SYMBOLS), keys]), np.concatenate([np.log10(root), values])
    blocks, held = [[]], 0
    for r in sizes:
        if held and held + r["count"] > BLOCK:
            blocks.append([])
            held = 0
        blocks[-1].append(r["grp"])
        held += r["count"]
    for k, block in enumerate(blocks):
        k_, v_ = np.zeros(0, np.int64), np.zeros(0)
        if block:
            got = table.where(F.col("grp").between(block[0], block[-1])).select("k", "v").toArrow()
            k_, v_ = got["k"].to_numpy(), got["v"].to_numpy()
        of = None if len(blocks) == 1 else (block[0] if k else 0, blocks[k + 1][0] - 1 if k + 1 < len(blocks) else NODE)
        yield Tree(depth, np.append(nodes, -k_[k_ < 0]), np.append(shares, v_[k_ < 0]), np.append(keys, k_[k_ > 0]), np.append(values, v_[k_ > 0]), of)


def grow(grams: DataFrame, depth: int = DEPTH, min_count: float = MIN_COUNT) -> Tree:
    """The tree of the spelled contexts (g, n), if it is one block."""
    tree, *more = trees(grams, depth, min_count)
    if more:
        raise ValueError("the tree has several blocks")
    return tree


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    train = docs.where(~held).select("text")
    counted = materialise(train.mapInArrow(lambda b: _count(b, depth), "w string, g long, n long").groupBy("w", "g").agg(F.sum("n").alias("n")))
    blocks = trees(counted.where("g is not null").select("g", "n"), depth)
    vocabulary = counted.where("w is not null").select("w", F.col("n").alias("c"))
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    denominator = n + 0.1 * (v + 1)
    head = vocabulary.where(F.col("c") >= max(1.0, HEAD_SHARE * n)).toArrow().combine_chunks()
    ends = next((c for w, c in zip(head["w"], head["c"].to_pylist(), strict=True) if not w.as_py()), 0) if head.num_rows else 0
    if not ends:
        ends = (vocabulary.where("w = ''").agg(F.sum("c")).first()[0]) or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts, tree = docs.select("doc_id", held.alias("held_out"), "text", F.lit(0.0).alias("part")), next(blocks)
    for after in blocks:  # a pass for each block but the last
        part = spark.sparkContext.broadcast(tree)
        texts = materialise(texts.mapInArrow(lambda b, part=part: _pass(b, part), f"doc_id {kind}, held_out boolean, text string, part double"))
        part.unpersist()
        tree = after
    shipped = spark.sparkContext.broadcast((tree, *_head(head), denominator, ends))
    scored = texts.mapInArrow(lambda b: _score(b, shipped), f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, words string")
    scored = materialise(scored.withColumn("r", F.monotonically_increasing_id()))
    tail = scored.where("words <> ''").select("r", F.explode(F.split("words", " ")).alias("w"))
    value = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(float(denominator)))
    tail = tail.join(vocabulary, "w", "left").groupBy("r").agg(F.sum(value).alias("b"), F.count(F.when(F.col("c") > 0, 1)).alias("k"))
    return scored.join(tail, "r", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _head(head: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the frequent words, ascending, and their counts."""
    column = head["w"].combine_chunks() if head.num_rows else pa.array([], pa.string())
    found = Words(Texts(column), NONSPACE)
    keys, values = found.hashes(), head["c"].to_numpy().astype(np.float64)[found.counts == 1]  # not the end
    order = np.argsort(keys)
    return keys[order], values[order]


def _pass(batches: Iterable[pa.RecordBatch], shipped) -> Iterator[pa.RecordBatch]:
    """Adds a block's scores to those of the blocks before."""
    for whole in batches:
        for batch in slices(whole, "text"):
            part = shipped.value.score(Stream(Texts(batch.column(2)))) + np.asarray(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(part)], ["doc_id", "held_out", "text", "part"])


def _score(batches: Iterable[pa.RecordBatch], shipped) -> Iterator[pa.RecordBatch]:
    """Scores, base sums over known frequent words, and each text's other occurrences, spelled, for the join."""
    tree, keys, values, denominator, ends = shipped.value
    for whole in batches:
        for batch in slices(whole, "text"):
            texts = Texts(batch.column(2))
            score = tree.score(Stream(texts)) + np.asarray(batch.column(3))
            found = Words(texts, NONSPACE)
            h, m = found.hashes(), len(texts)
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            doc = found.doc()
            c = values[at[known]] if len(keys) else np.zeros(0)
            base = np.bincount(doc[known], np.log10((c + 0.1) / denominator), m) + math.log10((ends + 0.1) / denominator)
            n_known = np.bincount(doc[known], minlength=m) + int(ends > 0)
            rest = np.flatnonzero(~known)
            low, owner = found.lower.tobytes(), doc[rest]
            spelled = [low[a:b] for a, b in zip(found.starts[rest].tolist(), found.ends[rest].tolist(), strict=True)]
            cut = np.searchsorted(owner, np.arange(m + 1)).tolist()
            words = [b" ".join(spelled[a:b]).decode() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.counts + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score), pa.array(words, pa.string())],
                ["doc_id", "held_out", "n_tokens", "known", "base", "score", "words"],
            )
