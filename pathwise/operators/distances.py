"""Pairwise distances of a pool's sequences as a long table (id_a, id_b, distance) with id_a < id_b.

Sequences are ordered by their states and cut into blocks of equal size, and a tile is a pair of blocks. Equal
sequences are neighbours, so a block is sent to its tiles as its different sequences with the ids of each. A
task computes the distances of different sequences once and writes them out for all pairs of ids. It holds two
blocks, and no pair crosses the network. The cost of a tile is in its pairs, not its bytes, so tiles are dealt
to a stated number of tasks that Spark does not coalesce, and small pools have smaller blocks, so that there
are tiles for all cores. Sums over pairs (quality, representatives) need no pairs of ids at all: class_sums
weighs each pair of different sequences by the numbers of their copies.

Nulls: a sequence without an id is left out, as no row could name it. A null state is one more state of the
pool, equal to itself and unlike all others, in every method; a given cost matrix needs a last row and
column for it.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from pathwise.functions.runtime import materialise
from pathwise.operators.kernels import KERNELS, Batch, levenshtein

#: Sequences of a block, at most and (where more tiles are wanted) at least.
BLOCK, LEAST_BLOCK = 1024, 8
#: Tiles for each core that small pools are cut into. Tasks for each core, of which more come only by as many tiles for each: a task writes
#: a file, and on Hadoop's local files each file starts processes beside the executor, which count as copies of it until they run.
TILES_A_CORE, TASKS_A_CORE, TILES_A_TASK = 8, 32, 16
#: Values that Parquet packs together: equal groups of so many are equal bytes, which are compressed to a few. Blocks from MANY on are made of whole groups.
GROUP, MANY = 8, 256
BATCH_CELLS = 1 << 22
#: Different sequences of a dense matrix, which takes 8 bytes for each pair of them on the driver, and ids beside it.
MAX_DENSE, MAX_IDS = 8192, 1 << 22
COLUMNS = ("id_a", "id_b", "distance")
#: From different sequences (arrays of codes) and their number of states to the distances of the places i and j.
Pairwise = Callable[[list[np.ndarray]], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def grid(n: int, cores: int) -> tuple[int, int]:
    """Blocks of a side for n sequences, and tasks to deal the tiles to."""
    wanted = math.ceil(math.sqrt(2 * TILES_A_CORE * cores))
    g = max(1, math.ceil(n / BLOCK), min(wanted, math.ceil(n / LEAST_BLOCK)))
    tiles = g * (g + 1) // 2
    return g, min(tiles, max(TASKS_A_CORE * cores, tiles // TILES_A_TASK))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their place in the order, from 0; written, as places need the sizes of the parts before."""
    spread = materialise(rows.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order))
    part = F.spark_partition_id()
    sizes = {r.p: r.c for r in spread.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect()}
    starts, at = [], 0
    for p in range(max(sizes, default=0) + 1):
        starts.append(at)
        at += sizes.get(p, 0)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spread.withColumn("place", F.array(*map(F.lit, starts))[part].cast("long") + within)


def block_size(n: int, g: int) -> int:
    """Sequences of each of g blocks, the last ones excepted."""
    size = max(1, math.ceil(n / g))
    return size if size < MANY else math.ceil(size / GROUP) * GROUP


def tiled(rows: DataFrame, n: int, members: str) -> DataFrame:
    """Blocks of ``rows`` (place, codes, members) at n places, dealt by tile: a row (block, classes, x, y) for each block of a tile, x <= y.

    ``classes`` has a struct for each of the block's different codes, with a list of its rows' members.
    """
    g, tasks = grid(n, rows.sparkSession.sparkContext.defaultParallelism)
    own = rows.withColumn("block", F.floor(F.col("place") / block_size(n, g)).cast("int"))
    classes = own.groupBy("block", "codes").agg(F.collect_list(members).alias("members"))
    blocks = classes.groupBy("block").agg(F.collect_list(F.struct("codes", "members")).alias("classes"))
    tiles = F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")))
    return blocks.withColumn("tile", F.explode(tiles)).select("block", "classes", "tile.x", "tile.y").repartition(tasks, "x", "y")


def _unpacked(table: pa.Table) -> tuple[list[np.ndarray], pa.Array, np.ndarray, np.ndarray, bool]:
    """Codes of the classes, members, class of each member, whether a class is of the first block, and whether the tile is one block with itself."""
    x, y = table["x"][0].as_py(), table["y"][0].as_py()
    column = pa.concat_arrays(table["classes"].chunks)
    first = np.repeat(np.array(table["block"].to_pylist()) == x, pc.list_value_length(column).to_numpy(zero_copy_only=False))
    codes, members = (pc.struct_field(column.flatten(), [c]) for c in (0, 1))
    ends = np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False))
    each = np.split(codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends[:-1])
    of = np.repeat(np.arange(len(each)), pc.list_value_length(members).to_numpy(zero_copy_only=False))
    return each, members.flatten(), of, first, x == y


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero by the shortest decimal of a number, as Spark's round does."""
    scaled = np.where(np.isfinite(x), x, 0.0) * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return np.where(np.isfinite(x), out, x)


def tile_rows(seqs: DataFrame, n: int, values: dict[str, Pairwise], symmetric: bool = False, digits: int | None = None) -> DataFrame:
    """All pairs of (id, codes), packed: each of ``ids_a`` meets each of ``ids_b``, with a list for each of ``values`` beside ``ids_b``.

    Where the order of a pair is of no account, copies of a class are the ids_a of one row, so a task sends a list for
    each class that it has met and not a row for each pair; else, and within a block, each id has a row.

    ``turn`` of one of ids_a is the first place of the group of ids_b in which ids go from lesser to greater than it, or
    their number if there is none.
    """
    kind = seqs.schema["id"].dataType

    def run(table: pa.Table) -> pa.Table:
        codes, members, of, first, inner = _unpacked(table)
        m, ranks = len(codes), np.empty(len(of), np.int64)
        ranks[pc.sort_indices(members).to_numpy()] = np.arange(len(of))
        low, high = np.full(m, len(of)), np.full(m, -1)
        np.minimum.at(low, of, ranks)
        np.maximum.at(high, of, ranks)
        met = np.ones((m, m), bool) if inner else first[:, None] != first[None, :]
        i, j = np.nonzero(np.triu(met) if symmetric else met & (low[:, None] < high[None, :]))
        dense = {}
        for name, prepare in values.items():
            d = prepare(codes)(i, j)
            dense[name] = np.zeros((m, m))
            dense[name][i, j] = d if digits is None else rounded(d, digits)
            if symmetric:
                dense[name][j, i] = dense[name][i, j]
        turned = pa.struct([pa.field("id", members.type, False), pa.field("turn", pa.int32(), False)])
        kinds = pa.schema([pa.field(c, pa.list_(pa.field("element", x, False)), False) for c, x in [("ids_a", turned), ("ids_b", members.type), *((c, pa.float64()) for c in values)]])
        fewer = first if inner or first.sum() * 2 <= m else ~first
        left, right = np.flatnonzero(fewer[of]), np.arange(len(of)) if inner else np.flatnonzero(~fewer[of])
        right = right if inner else right[np.argsort(ranks[right])]
        starts = left if inner or not symmetric else left[np.flatnonzero(np.diff(of[left], prepend=-1))]
        ends = np.append(starts[1:], left[-1:] + 1)
        turns = np.full(len(of), len(right), np.int32)
        if not inner:
            lesser_ones = np.searchsorted(ranks[right], ranks)
            start = lesser_ones // GROUP * GROUP
            turns = np.where((lesser_ones == start) | (start + GROUP > len(right)), turns, start).astype(np.int32)
        batches, step = [], max(1, (1 << 18) // max(1, len(right)))
        for at in range(0, len(starts), step):
            s, e = starts[at : at + step], ends[at : at + step]
            here = np.ix_(of[s], of[right])
            lesser = None if symmetric else ranks[s][:, None] < ranks[right][None, :]
            cells = [d[here] if symmetric else np.where(lesser, d[here], d.T[here]) for d in dense.values()]
            after = right[None, :] > s[:, None] if inner else np.ones((len(s), len(right)), bool)
            offsets = pa.array(np.append(0, np.cumsum(after.sum(1))), pa.int32())
            own = pa.array(np.append(s, e[-1]) - s[0], pa.int32())
            own_ids = pa.StructArray.from_arrays([members.slice(s[0], e[-1] - s[0]), pa.array(turns[s[0] : e[-1]])], fields=list(turned))
            lists = [own_ids, members.take(pa.array(np.broadcast_to(right, after.shape)[after])), *(pa.array(c[after]) for c in cells)]
            batches.append(pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(o, x, type=t) for o, x, t in zip([own, *[offsets] * (len(lists) - 1)], lists, kinds.types)], schema=kinds))
        return pa.Table.from_batches(batches, kinds)

    columns = [StructField(c, ArrayType(x, False), False) for c, x in [("ids_a", StructType([StructField("id", kind, False), StructField("turn", IntegerType(), False)])), ("ids_b", kind), *((c, DoubleType()) for c in values)]]
    return tiled(placed(seqs.select("id", "codes"), "codes", "id"), n, "id").groupBy("x", "y").applyInArrow(run, StructType(columns))


def tile_pairs(seqs: DataFrame, n: int, values: dict[str, Pairwise], symmetric: bool = False, digits: int | None = None) -> DataFrame:
    """All pairs of (id, codes) with a column for each of ``values``; the first of a pair is that of the lesser id.

    No column may be null, and the types say so: a writer then has no levels to keep for each of them. Code that is generated for
    both explodes at once would hold all pairs of a packed row before it hands on the first; a lambda keeps the first explode out
    of it, so the pairs of one of ids_a are held.

    Pairs of an id are in the order of ids_b, but the group of its turn comes last. So a column of ids has the id itself over and
    over, or whole groups, which are the same bytes for each id that meets them.
    """
    packed = tile_rows(seqs, n, values, symmetric, digits)
    lists = {name: F.col(f"in_{name}") for name in values}
    each = packed.select(F.explode(F.transform("ids_a", lambda x: x)).alias("a"), "ids_b", *(F.col(name).alias(f"in_{name}") for name in values))
    each = each.select(F.col("a.id").alias("a"), F.col("a.turn").alias("turn"), (F.size("ids_b") - GROUP).alias("last"), "ids_b", *lists.values())
    each = each.select("a", "turn", "last", "ids_b", F.posexplode("ids_b").alias("at", "b"), *lists.values())
    at = F.when(F.col("at") < F.col("turn"), F.col("at")).when(F.col("at") < F.col("last"), F.col("at") + GROUP).otherwise(F.col("at") - F.col("last") + F.col("turn"))
    each = each.select("a", "b", "ids_b", at.alias("at"), *lists.values())
    each = each.select("a", F.coalesce(F.get("ids_b", "at"), "b").alias("b"), *(F.coalesce(F.get(x, "at"), F.lit(math.nan)).alias(name) for name, x in lists.items()))
    return each.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), *values)


def class_sums(classes: DataFrame, n: int, prepare: Pairwise, weights: Callable[[np.ndarray], list[np.ndarray]], names: list[str]) -> DataFrame:
    """(place, cluster, ...): sums over all members of a cluster of functions of their distances to the class at a place.

    ``classes`` is (place, codes, clusters), with structs (cluster, n) for the numbers of a class's members.
    """
    kind = next(f.dataType.elementType["cluster"].dataType.simpleString() for f in classes.schema if f.name == "clusters")

    def run(table: pa.Table) -> pa.Table:
        codes, members, of, first, inner = _unpacked(table)
        place = np.empty(len(codes), np.int64)
        place[of] = pc.struct_field(members, [0]).to_numpy(zero_copy_only=False)
        listed = pc.struct_field(members, [1])
        owner = np.repeat(of, pc.list_value_length(listed).to_numpy(zero_copy_only=False))
        cluster, count = (pc.struct_field(listed.flatten(), [c]) for c in (0, 1))
        coded = cluster.dictionary_encode()
        sizes = np.zeros((len(codes), len(coded.dictionary)))
        sizes[owner, coded.indices.to_numpy(zero_copy_only=False)] = count.to_numpy(zero_copy_only=False)
        rows = np.arange(len(codes))
        a, b = (rows, rows) if inner else (rows[first], rows[~first])
        d = prepare(codes)(np.repeat(a, len(b)), np.tile(b, len(a))).reshape(len(a), len(b))
        found = [weights(d)] if inner else [weights(d), [w.T for w in weights(d)]]
        out = [[], [], [[] for _ in names]]
        for (left, right), each in zip(((a, b), (b, a)), found):
            present = np.flatnonzero(sizes[right].any(0))
            out[0].append(np.repeat(place[left], len(present)))
            out[1].append(np.tile(present, len(left)))
            for k, w in enumerate(each):
                out[2][k].append((w @ sizes[np.ix_(right, present)]).ravel())
        return pa.table({"place": np.concatenate(out[0]), "cluster": coded.dictionary.take(pa.array(np.concatenate(out[1]))), **{c: np.concatenate(v) for c, v in zip(names, out[2])}})

    columns = ", ".join(f"{c} double" for c in names)
    parts = tiled(classes.withColumn("m", F.struct("place", "clusters")), n, "m").groupBy("x", "y").applyInArrow(run, f"place long, cluster {kind}, {columns}")
    return parts.groupBy("place", "cluster").agg(*(F.sum(c).alias(c) for c in names))


def class_median(classes: DataFrame, n: int, prepare: Pairwise) -> float:
    """The median of the distances of all pairs of members, exactly: its bits are found from the highest in three passes.

    ``classes`` is as in class_sums. A pass gets the pairs' numbers by the next 21 or 22 bits of their distances.
    """
    total = classes.select(F.explode("clusters").alias("c")).agg(F.sum("c.n").alias("n")).first().n or 0
    pairs = total * (total - 1) // 2
    if not pairs:
        return 0.0

    def counted(shift: int, prefixes: list[int], above: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            codes, members, of, first, inner = _unpacked(table)
            listed = pc.struct_field(members, [1])
            size = np.zeros(len(codes))
            np.add.at(size, np.repeat(of, pc.list_value_length(listed).to_numpy(zero_copy_only=False)), pc.struct_field(listed.flatten(), [1]).to_numpy(zero_copy_only=False))
            i, j = np.nonzero(np.triu(np.ones((len(codes),) * 2, bool) if inner else first[:, None] != first[None, :]))
            weight = np.where(i == j, size[i] * (size[i] - 1) / 2, size[i] * size[j])
            bits = (prepare(codes)(i, j) + 0.0).view(np.int64)
            out = [], [], []
            for k, prefix in enumerate(prefixes):
                here = (bits >> above == prefix) & (weight > 0)
                digits, place = np.unique(bits[here] >> shift, return_inverse=True)
                out[0].append(np.full(len(digits), k))
                out[1].append(digits)
                out[2].append(np.bincount(place, weight[here], len(digits)).astype(np.int64))
            return pa.table({c: np.concatenate(v) for c, v in zip("kbw", out)})

        return run

    dealt = tiled(classes.withColumn("m", F.struct("place", "clusters")), n, "m").groupBy("x", "y")
    ranks, prefixes, above = [(pairs - 1) // 2, pairs // 2], [0, 0], 63
    for shift in (42, 21, 0):
        wanted = sorted(set(prefixes))
        parts = dealt.applyInArrow(counted(shift, wanted, above), "k long, b long, w long")
        got = parts.groupBy("k", "b").agg(F.sum("w").alias("w")).orderBy("k", "b").toArrow()
        k, b, w = (got[c].to_numpy() for c in "kbw")
        for at in range(2):
            own = k == wanted.index(prefixes[at])
            upto = np.cumsum(w[own])
            found = int(np.searchsorted(upto, ranks[at], "right"))
            ranks[at] -= int(upto[found] - w[own][found])
            prefixes[at] = int(b[own][found])
        above = shift
    low, high = np.array(prefixes, np.int64).view(np.float64)
    return float((low + high) / 2)


# --- distances of prepared sequences ---------------------------------------------------------------


def _in_steps(one: Callable[[np.ndarray, np.ndarray], np.ndarray], cells: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``one`` over so many pairs at a time that they have BATCH_CELLS cells."""
    step = max(1, BATCH_CELLS // max(1, cells))
    return lambda i, j: np.concatenate([one(i[at : at + step], j[at : at + step]) for at in range(0, len(i), step)] or [np.zeros(0)])


def _batched(kernel: Callable) -> Pairwise:
    """A kernel over batches of pairs."""

    def prepare(codes):
        size = np.array([len(c) for c in codes], np.int64)
        padded = Batch._padded(codes, size)

        def one(i, j):
            t = Batch.__new__(Batch)
            t.la, t.lb = size[i], size[j]
            t.a, t.b = padded[: t.la.max(initial=0), i], padded[: t.lb.max(initial=0), j]
            return kernel(t)

        return _in_steps(one, len(padded) + 1)

    return prepare


def _featured(features: Callable, value: Callable) -> Pairwise:
    """A function of two sequences' rows of numbers, which are computed once."""

    def prepare(codes):
        f = features(codes)
        return _in_steps(lambda i, j: value(f, i, j), f.shape[1])

    return prepare


def _counted(k: int) -> Callable:
    return lambda codes: np.array([np.bincount(c, minlength=k) for c in codes], float).reshape(len(codes), k)


def _hamming(k, normalize=False):
    return _batched(lambda t: (t.a != t.b).sum(0) / (np.maximum(t.la, 1) if normalize else 1.0))


def _prefix(k, normalize=False, back=False):
    def value(t):
        low, total = np.minimum(t.la, t.lb), t.la + t.lb
        size = min(len(t.a), len(t.b))
        differs = np.concatenate([t.a[:size] != t.b[:size], np.ones((1, len(low)), bool)])
        d = (total - 2 * np.minimum(differs.argmax(0), low)).astype(float)
        return d / total if normalize else d

    turned = _batched(value)
    return (lambda codes: turned([c[::-1] for c in codes])) if back else turned


def _rlcp(k, normalize=False):
    return _prefix(k, normalize, back=True)


def _euclidean(k, n_states=None, normalize=False):
    def value(f, i, j):
        d = np.sqrt(sum(((f[i, s] - f[j, s]) ** 2 for s in range(k)), np.zeros(len(i))))
        return d / math.sqrt(2) if normalize else d

    def shares(codes):
        c = _counted(k)(codes)
        return c / c.sum(1, keepdims=True)

    return _featured(shares, value)


def _chi2(k, n_states=None, normalize=False, weights=None):
    def value(f, i, j):
        d, present = np.zeros(len(i)), np.zeros(len(i))
        for s in range(k):
            x, y = f[i, s], f[j, s]
            d += (1.0 if weights is None else weights[s]) * ((x - y) * (x - y) / np.maximum(x + y, 1.0))
            present += x + y > 0
        return d / 2 / (np.maximum(present, 1) if normalize else 1.0)

    return _featured(_counted(k), value)


def _svrspell(k, n_states=None):
    """L1 distance of each state's spell lengths, sorted from long to short."""

    def lengths(codes):
        out = [list(_spells(c, k)) for c in codes]
        most = max((len(x) for o in out for x in o), default=0)
        return np.array([[x + [0] * (most - len(x)) for x in o] for o in out], float).reshape(len(codes), -1)

    return _featured(lengths, lambda f, i, j: np.abs(f[i] - f[j]).sum(1))


def _spells(s: np.ndarray, k: int) -> Iterator[list[int]]:
    runs = np.split(s, np.flatnonzero(np.diff(s)) + 1)
    for state in range(k):
        yield sorted((len(r) for r in runs if len(r) and r[0] == state), reverse=True)


def _om_unit(k, normalize=False):
    """Optimal matching with unit costs is the edit distance."""
    return _batched(lambda t: levenshtein(t, k) / (t.longest if normalize else 1.0))


NATIVE = {"hamming": _hamming, "lcp": _prefix, "rlcp": _rlcp, "euclidean": _euclidean, "chi2": _chi2, "svrspell": _svrspell}
METHODS = tuple(sorted({*NATIVE, *KERNELS}))
EQUAL_LENGTH = ("hamming", "dhd")


def coded(pool) -> tuple[DataFrame, int, int, int, int]:
    """Sequences (id, codes, n) with an id, the number of states with the null state if there is one, and their number, least and greatest length."""
    seqs, k = pool.sequences.where("id is not null").select("id", "codes", "n"), len(pool.alphabet)
    r = seqs.agg(F.count("*").alias("n"), F.min("n").alias("a"), F.max("n").alias("b"), F.max(F.exists("codes", lambda c: c.isNull())).alias("nulls")).first()
    if r.nulls:
        seqs, k = seqs.withColumn("codes", F.transform("codes", lambda c: F.coalesce(c, F.lit(k)))), k + 1
    return seqs, k, r.n, r.a or 0, r.b or 0


def position_costs(pool) -> np.ndarray:
    """(T, K, K) costs from the share of sequences in each state at each position: clamp(1 - 4 f_a f_b)."""
    seqs, k, n, _, longest = coded(pool)
    rows = seqs.select(F.posexplode("codes").alias("pos", "code")).groupBy("pos", "code").agg(F.count("*").alias("c")).collect()
    share = np.zeros((longest, k))
    for r in rows:
        share[r.pos, r.code] = r.c / max(1, n)
    a, b = share[:, :, None], share[:, None, :]
    out = np.clip(1 - a * b / 0.25, 0, 1)
    out[(a == 0) & (b == 0)] = 1.0
    out[:, np.arange(k), np.arange(k)] = 0.0
    return out


@dataclass
class Source:
    """Sequences (id, codes), their number, and what gives their distances.

    ``metric`` says that a distance does not depend on the order of its sequences and is 0 for equal ones.
    """

    seqs: DataFrame
    n: int
    pairwise: Pairwise
    metric: bool

    def pairs(self, digits: int | None = None) -> DataFrame:
        return tile_pairs(self.seqs, self.n, {"distance": self.pairwise}, self.metric, digits)


@dataclass
class Classes:
    """The matrix of different sequences, in the order of their first places; the class of each place; the sizes."""

    dense: np.ndarray
    of: np.ndarray
    size: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.unique(self.of, return_index=True)[1]


class DistanceMatrix:
    """Distances as a long table; small ones also as a dense matrix in the order of the sorted ids.

    ``classes`` is the matrix of the different sequences only, which stays small where many are copies.
    """

    def __init__(self, pairs: DataFrame | None = None, labels: list | None = None, ids: DataFrame | None = None, values: np.ndarray | None = None, source: Source | None = None) -> None:
        if values is not None:
            values = np.asarray(values, float)
            if values.ndim != 2 or values.shape[0] != values.shape[1]:
                raise ValueError("a distance matrix is square and has two dimensions")
        self._pairs, self.ids, self._labels, self._values, self.source, self._classes = pairs, ids, labels, values, source, None

    @property
    def pairs(self) -> DataFrame | None:
        if self._pairs is None and self.source is not None:
            self._pairs = self.source.pairs()
        return self._pairs

    def rounded_pairs(self, digits: int) -> DataFrame:
        """The long table with rounded distances."""
        if self.source is not None:
            return self.source.pairs(digits)
        return self.pairs.withColumn("distance", F.round("distance", digits))

    @property
    def labels(self) -> list | None:
        if self._labels is None and self.ids is not None:
            self._labels = self.ids.orderBy("id").limit(MAX_IDS + 1).toArrow()["id"].to_pylist()
            _at_most(len(self._labels), MAX_IDS, "ids")
        return self._labels

    @property
    def values(self) -> np.ndarray:
        if self._values is None:
            _at_most(len(self.labels), MAX_DENSE, "sequences")
            place = {x: i for i, x in enumerate(self.labels)}
            out = np.zeros((len(place),) * 2)
            got = self.pairs.toArrow()
            i, j = (np.array([place[x] for x in got[c].to_pylist()], int) for c in ("id_a", "id_b"))
            out[i, j] = out[j, i] = got["distance"].to_numpy()
            self._values = out
        return self._values

    @property
    def classes(self) -> Classes:
        """Equal sequences as one, where that loses nothing; else each by itself."""
        if self._classes is None:
            if self.source is None or not self.source.metric:
                d = self.values
                self._classes = Classes(d, np.arange(len(d)), np.ones(len(d)))
            else:
                seqs = self.source.seqs
                found = materialise(seqs.groupBy("codes").agg(F.min("id").alias("first")))
                u = found.count()
                _at_most(u, MAX_DENSE, "different sequences")
                own = seqs.join(F.broadcast(found), "codes").select("id", "first").orderBy("id").limit(MAX_IDS + 1).toArrow()
                _at_most(len(own), MAX_IDS, "ids")
                self._labels, firsts = own["id"].to_pylist(), own["first"].to_pylist()
                place = {x: i for i, x in enumerate(dict.fromkeys(firsts))}
                of = np.array([place[x] for x in firsts], int)
                dense = DistanceMatrix(labels=list(place), source=Source(found.select(F.col("first").alias("id"), "codes"), u, self.source.pairwise, True)).values
                self._classes = Classes(dense, of, np.bincount(of, minlength=u).astype(float))
        return self._classes

    @property
    def n(self) -> int:
        return len(self.values) if self.labels is None else len(self.labels)

    @property
    def shape(self) -> tuple[int, int]:
        return self.n, self.n

    def __getitem__(self, key):
        return self.values[key]

    def get_distance(self, id1, id2) -> float:
        if self.labels is None:
            raise ValueError("the matrix has no labels")
        return float(self.values[self.labels.index(id1), self.labels.index(id2)])

    def to_condensed(self) -> np.ndarray:
        return self.values[np.triu_indices(self.n, 1)]

    @classmethod
    def from_condensed(cls, condensed, labels: list | None = None) -> DistanceMatrix:
        c = np.asarray(condensed, float)
        n = int(round((1 + math.sqrt(1 + 8 * len(c))) / 2))
        if n * (n - 1) // 2 != len(c):
            raise ValueError("not the length of a condensed matrix")
        out = np.zeros((n, n))
        out[np.triu_indices(n, 1)] = c
        return cls(values=out + out.T, labels=labels)

    @classmethod
    def coerce(cls, x) -> DistanceMatrix:
        return x if isinstance(x, cls) else cls(values=x)

    def to_dataframe(self) -> DataFrame:
        return self.pairs


def _at_most(n: int, most: int, what: str) -> None:
    if n > most:
        raise ValueError(f"a dense matrix has {most} {what} at most; use clara_pool or the forms over the long table")


def compute(pool, method: str = "om", **options) -> DistanceMatrix:
    """The distances of all pairs of a pool's sequences."""
    if method not in METHODS:
        raise ValueError(f"Unknown method: {method!r}; one of {', '.join(METHODS)}")
    options.pop("n_jobs", None)
    seqs, k, n, shortest, longest = coded(pool)
    if method in EQUAL_LENGTH and shortest != longest:
        raise ValueError("sequences must have equal length")
    sm = options.get("sm", "constant")
    named = isinstance(sm, str) and options.get("position_costs") is None
    if method == "om" and named and options.get("indel", 1) == 1 and sm == "constant" and options.get("sub_cost", 2) == 1:
        pairwise = _om_unit(k, normalize=options.get("normalize", False))
    elif method in NATIVE:
        pairwise = NATIVE[method](k, **options)
    else:
        if method == "dhd" and options.get("position_costs") is None:
            options["position_costs"] = position_costs(pool)
        kernel = KERNELS[method]
        inspect.signature(kernel).bind(None, k, **options)  # an option that the metric lacks is a TypeError here, not in a task
        kernel(Batch([np.zeros(1, int)], [np.zeros(1, int)]), k, **options)
        pairwise = _batched(lambda t: kernel(t, k, **options))
    metric = method in NATIVE or method in ("om", "lcs", "dhd") and named
    return DistanceMatrix(ids=seqs.select("id"), source=Source(seqs.select("id", "codes"), n, pairwise, metric))


def _single(method: str):
    """The distance of two code arrays by a batched kernel."""

    def distance(a, b, **options) -> float:
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        k = int(max([*a.tolist(), *b.tolist()], default=0)) + 1
        return float(KERNELS[method](Batch([a], [b]), k, **options)[0])

    distance.__name__ = f"{method}_distance"
    return distance


optimal_matching_distance, lcs_distance, omloc_distance, omspell_distance, omstran_distance, dtw_distance, softdtw_distance, twed_distance, nms_distance, nmsmst_distance, dhd_distance = (
    _single(m) for m in ("om", "lcs", "omloc", "omspell", "omstran", "dtw", "softdtw", "twed", "nms", "nmsmst", "dhd")
)


def hamming_distance(a, b, normalize: bool = False) -> float:
    a, b = np.asarray(a), np.asarray(b)
    if len(a) != len(b):
        raise ValueError("sequences must have equal length")
    d = float((a != b).sum())
    return d / len(a) if normalize and len(a) else d


def lcs_length(a, b) -> int:
    """By bits, a row of the table as one number: a 0 is a place of ``a`` where the length grows."""
    a, b = (np.asarray(x, np.int64).tolist() for x in (a, b))
    at = dict.fromkeys(a, 0)
    for i, x in enumerate(a):
        at[x] |= 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        met = row & at.get(x, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def lcs_similarity(a, b) -> float:
    top = max(len(a), len(b))
    return lcs_length(a, b) / top if top else 1.0


def lcp_length(a, b) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def rlcp_length(a, b) -> int:
    return lcp_length(list(a)[::-1], list(b)[::-1])


def _by_length(length):
    def distance(a, b, normalize: bool = False) -> float:
        total = len(a) + len(b)
        d = float(total - 2 * length(a, b))
        return d / total if normalize and total else d

    def similarity(a, b) -> float:
        if not len(a) and not len(b):
            return 1.0
        low = min(len(a), len(b))
        return length(a, b) / low if low else 0.0

    return distance, similarity


lcp_distance, lcp_similarity = _by_length(lcp_length)
rlcp_distance, rlcp_similarity = _by_length(rlcp_length)


def state_distribution(codes, n_states: int | None = None) -> np.ndarray:
    """Shares of the states in one code array."""
    c = np.asarray(codes, np.int64)
    return np.bincount(c, minlength=n_states or 0) / max(1, len(c))


def _tables(a, b, n_states):
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    k = n_states or int(max([*a.tolist(), *b.tolist()], default=0)) + 1
    return a, b, k


def euclidean_distance(a, b, n_states: int | None = None, normalize: bool = False) -> float:
    a, b, k = _tables(a, b, n_states)
    if not len(a) or not len(b):
        return 0.0 if len(a) == len(b) else math.inf
    d = float(np.linalg.norm(state_distribution(a, k) - state_distribution(b, k)))
    return d / math.sqrt(2) if normalize else d


def chi2_distance_weighted(a, b, weights=None, n_states: int | None = None, normalize: bool = False) -> float:
    """Half the weighted sum of squared count differences over count sums; missing weights are 1."""
    a, b, k = _tables(a, b, n_states)
    if not len(a) or not len(b):
        return 0.0 if len(a) == len(b) else math.inf
    x, y = (np.bincount(s, minlength=k).astype(float) for s in (a, b))
    w = np.ones(len(x))
    if weights is not None:
        w[: min(len(w), len(weights))] = np.asarray(weights, float)[: len(w)]
    total = x + y
    d = float((w * np.divide((x - y) ** 2, total, out=np.zeros_like(total), where=total > 0)).sum() / 2)
    return d / max(1, int((total > 0).sum())) if normalize else d


def chi2_distance(a, b, n_states: int | None = None, normalize: bool = False) -> float:
    return chi2_distance_weighted(a, b, None, n_states, normalize)


def svrspell_distance(a, b, n_states: int | None = None) -> float:
    a, b, k = _tables(a, b, n_states)
    if not len(a) or not len(b):
        return float(max(len(a), len(b)))

    total = 0
    for x, y in zip(_spells(a, k), _spells(b, k), strict=True):
        size = max(len(x), len(y))
        total += sum(abs(p - q) for p, q in zip(x + [0] * (size - len(x)), y + [0] * (size - len(y)), strict=True))
    return float(total)


def softdtw_divergence(a, b, **options) -> float:
    return softdtw_distance(a, b, **options) - (softdtw_distance(a, a, **options) + softdtw_distance(b, b, **options)) / 2
