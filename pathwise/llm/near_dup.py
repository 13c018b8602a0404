"""Near duplicates by word shingles: a chosen-path similarity join.

Texts with equal shingle sets are one class. A class is sketched by ``COORDINATES`` min-hashes, a sample
of its tokens. Each run of the join starts a tree at the set of all classes: a node draws one coordinate
at random, and with the chance 1 / similarity - 1 a second, and splits its classes by their value there,
so a pair at the threshold meets in one child on average and dissimilar classes part. Nodes of at most
``BUCKET`` classes are brute-forced on sketches. A larger one is first swept by pivots drawn from it:
classes near a pivot are settled by its canopy and leave the node, so a large group of near copies is
not split over and over. The rest is split again, until no node is large. ``RUNS`` trees repeat this.

Sketches propose pairs that agree in ``PROPOSE`` of their coordinates. Agreement is a metric, so a canopy of
twice the distance holds every class that may be proposed with a settled one. A bucket or canopy sends
spanning edges only, and a group costs as many rows as it has classes. Proposals make families
(connected components); each family's texts, one for each class, meet once, in tiles of ``TILE`` classes,
where every pair that the sketches propose is decided by its exact Jaccard similarity. Links are counted
there and only spanning edges leave the task.

Recall: sketches miss a pair at the threshold with a chance of 3e-5; a pair with similarity 0.8 shares a
first-level bucket in all but 0.2 ** (RUNS * 1.25) of cases, and where those are all large, a child of
one in all but about 0.16 ** RUNS.

Cost: the work of a family grows with the square of its classes, as the links of each are asked for. A text
is shingled once for its sketch and once in each tile of its class; one of n words takes some 150 * n bytes.

Defined results: shingles are five consecutive words of the lower-cased text; a text of fewer words, but
not none, is one shingle; a text without words (or null) is a class of its own and has no links; a class
or group is named by its least id, null if it has none; repeated rows are repeated; rows of one id are
one document to ``keep_one``, which never drops rows without an id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathwise.llm.components import HELD, Sets, components
from pathwise.llm.runtime import materialise, neutral
from pathwise.llm.text import ALNUM, Texts, Words, mix, slices

WORDS = 5
#: The similarity 4/5 as a fraction, for exact comparisons.
NUMERATOR, DENOMINATOR = 4, 5
COORDINATES = 128
RUNS = 16
BUCKET = 400
PIVOTS = 4
TILE = 512
#: Sketch agreement that proposes a pair: four standard deviations below the threshold.
PROPOSE = 0.66
#: Agreement with a pivot of every class that may be proposed with one near the pivot: distances add up.
LOOSE = 2 * PROPOSE - 1
#: The chance that a node draws a second coordinate.
SECOND = DENOMINATOR / NUMERATOR - 1
#: Large buckets whose pivots are sent to all tasks, at PIVOTS * 150 bytes each; pivots of more are joined.
SENT = 20_000
#: Classes whose addresses are broadcast to the texts, at 60 bytes or so each; more are joined.
FEW = 200_000
SEED = 20240229

_RNG = np.random.default_rng(SEED)
_MUL = (_RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)
_PLACE = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=10_000)
def _drawn(node: int) -> list[int]:
    """The coordinates that a node draws, by its name."""
    one, two, more = (int(mix(np.array([node % (1 << 64)], np.uint64) + np.uint64(k))[0]) for k in (1, 2, 3))
    first = one % COORDINATES
    return [first, (first + 1 + two % (COORDINATES - 1)) % COORDINATES] if more < SECOND * 2.0**64 else [first]


def _roots() -> list[tuple[int, int]]:
    """(run, coordinate) drawn at each run's root."""
    return [(r, i) for r in range(RUNS) for i in _drawn(SEED + 1000 * r)]


ROOTS = _roots()


def shingle_sets(texts: Texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, ALNUM)
    h, first = words.hashes(), words.first
    n = len(h)
    full = np.zeros(n, np.uint64)
    for k in range(WORDS):
        full[: max(0, n - k)] += h[k:] * _PLACE[k]
    full = mix(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(full[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The min-hashes of a set, in 32 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 2048):
        y = x[a : a + 2048, None] * _MUL
        y += _ADD
        y ^= y >> np.uint32(15)
        np.minimum(out, y.min(0), out=out)
    return out


def fingerprint(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


_AT = np.array([i for _, i in ROOTS])
_SALT = mix(np.array([r for r, _ in ROOTS], np.uint64) * np.uint64(1009) + _AT.astype(np.uint64) + np.uint64(1))


def _described(shingles: np.ndarray) -> tuple[list[int], bytes]:
    """A set's root buckets, and its sketch in a byte for each coordinate."""
    x = sketch(shingles)
    return mix(x[_AT].astype(np.uint64) + _SALT).view(np.int64).tolist(), x.astype(np.uint8).tobytes()


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            prints, described, last = [], [], {}
            for s in shingle_sets(Texts(batch.column(1))):
                f = fingerprint(s)
                prints.append(f)
                if f is not None and f not in last:
                    last[f] = _described(s)
                described.append(last.get(f, (None, None)))
            roots, sketches = (pa.array([d[k] for d in described], kind) for k, kind in enumerate((pa.list_(pa.int64()), pa.binary())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.binary()), roots, sketches], ["doc_id", "at", "fp", "roots", "sketch"])


def _children(node: int, sketch: bytes) -> list[int]:
    """The children of a node that a class goes to, one for each coordinate the node draws."""
    at = np.array(_drawn(node))
    values = np.frombuffer(sketch, np.uint8)[at].astype(np.uint64) + np.uint64(256) * at.astype(np.uint64)
    return mix(values + mix(np.array([node], np.int64).view(np.uint64))).view(np.int64).tolist()


def _agreement(matrix: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (matrix == row).sum(1) / COORDINATES


def _propose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the proposed pairs of a task's small buckets (members sorted by fingerprint)."""
    sets = Sets()
    for batch in batches:
        for members in batch.column(0):
            rows = members.as_py()
            fps, m = [r["fp"] for r in rows], np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(-1, COORDINATES)
            for i in range(len(fps) - 1):
                for j in np.flatnonzero(_agreement(m[i + 1 :], m[i]) >= PROPOSE).tolist():
                    sets.join(fps[i], fps[i + 1 + j])
        if len(sets.up) > HELD:
            yield from sets.stars(pa.binary())
    yield from sets.stars(pa.binary())


def _canopies(batches: Iterable[pa.RecordBatch], shipped=None) -> Iterator[pa.RecordBatch]:
    """For a row of a large bucket and the bucket's pivots: the pivots whose canopy it is in and, if none settles it, the children it goes to.

    Pivots near each other are one group, named by its least pivot: a row lists a group once.
    """
    groups: dict[int, tuple[np.ndarray, list[bytes]]] = {}
    for batch in batches:
        canopies, children = [], []
        buckets, *columns = (c.to_pylist() for c in batch.columns)
        if shipped is not None:
            columns.append([shipped.value[b] for b in buckets])
        for bucket, fp, sk, pivots in zip(buckets, *columns, strict=True):
            if bucket not in groups:
                if len(groups) > 1000:
                    groups.clear()
                pivots = sorted(pivots, key=lambda p: p["fp"])
                m = np.frombuffer(b"".join(p["sketch"] for p in pivots), np.uint8).reshape(-1, COORDINATES)
                sets = Sets()
                for i in range(len(pivots) - 1):
                    for j in np.flatnonzero(_agreement(m[i + 1 :], m[i]) >= PROPOSE).tolist():
                        sets.join(i, i + 1 + j)
                groups[bucket] = m, [pivots[sets.root(i)]["fp"] for i in range(len(pivots))]
            m, names = groups[bucket]
            near = _agreement(m, np.frombuffer(sk, np.uint8))
            canopies.append(sorted({names[i] for i in np.flatnonzero(near >= LOOSE).tolist()} - {fp}))
            children.append([] if (near >= PROPOSE).any() else _children(bucket, sk))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(canopies, pa.list_(pa.binary())), pa.array(children, pa.list_(pa.int64()))], ["fp", "sketch", "near", "children"])


def _swept(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canopy edges of large buckets (bucket, fp, sketch), and the children of the rows that no pivot settles.

    A bucket's pivots are the least hashes of PIVOTS slots, merged before they are shuffled. What is
    near a pivot is settled: all its partners are in that pivot's canopy.
    """
    h = F.xxhash64("fp", "bucket")
    least = [F.min(F.when(F.pmod(h, F.lit(PIVOTS)) == k, F.struct(h.alias("h"), "fp", "sketch"))) for k in range(PIVOTS)]
    pivots = materialise(large.groupBy("bucket").agg(F.array_compact(F.array(*least)).alias("pivots")))
    kind = "fp binary, sketch binary, near array<binary>, children array<long>"
    rows = pivots.limit(SENT + 1).collect()
    if len(rows) <= SENT:
        shipped = large.sparkSession.sparkContext.broadcast({r.bucket: [{"fp": bytes(p.fp), "sketch": bytes(p.sketch)} for p in r.pivots] for r in rows})
        swept = large.mapInArrow(lambda b: _canopies(b, shipped), kind)
    else:
        swept = large.join(pivots, "bucket").select("bucket", "fp", "sketch", "pivots").mapInArrow(_canopies, kind)
    swept = materialise(swept)
    return swept.select(F.explode("near").alias("a"), F.col("fp").alias("b")), swept.select(F.explode("children").alias("bucket"), "fp", "sketch")


def proposals(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints of ``classes`` (fp, roots, sketch) that may be similar."""
    nodes, canopies, smalls = classes.select(F.explode("roots").alias("bucket"), "fp"), [], []
    while True:
        # The same classes often meet in many buckets; one small bucket of each set of members is enough.
        sizes = nodes.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("who")).where("n > 1")
        own = F.when(F.col("n") > BUCKET, F.col("bucket"))
        sizes = sizes.groupBy("n", "who", own.alias("own")).agg(F.min("bucket").alias("bucket"))
        met = nodes.join(sizes.select("bucket", "n"), "bucket")
        met = materialise((met if smalls else met.join(classes.select("fp", "sketch"), "fp")).select("bucket", "fp", "sketch", "n"))
        smalls.append(met.where(F.col("n") <= BUCKET).select("bucket", "fp", "sketch"))
        large = met.where(F.col("n") > BUCKET).select("bucket", "fp", "sketch")
        if not large.take(1):
            break
        edges, nodes = _swept(large)
        canopies.append(edges)
    # Nodes of different levels have different names, so all small ones are searched at once.
    small = reduce(DataFrame.unionByName, smalls).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("fp", "sketch"))).alias("m"))
    return reduce(DataFrame.unionByName, canopies, small.select("m").mapInArrow(_propose, "a binary, b binary"))


def _exact(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The proposed pairs of a tile: the two blocks' classes against each other. Gives link counts and spanning edges."""
    tile_x, tile_y = key[1].as_py(), key[2].as_py()
    names = ["fp", "block", "sketch", "text"]
    rows: dict[bytes, tuple[int, bytes, np.ndarray]] = {}
    for batch in batches:
        whole = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names], names)
        for part in slices(whole, "text"):
            fps, blocks, sketches = (part.column(k).to_pylist() for k in range(3))
            for fp, block, sk, s in zip(fps, blocks, sketches, shingle_sets(Texts(part.column(3))), strict=True):
                rows[fp] = (block, sk, s)
    fps = sorted(rows)
    if not fps:
        return
    sets = [rows[f][2] for f in fps]
    where = np.array([rows[f][0] for f in fps])
    sketched = np.frombuffer(b"".join(rows[f][1] for f in fps), np.uint8).reshape(-1, COORDINATES)
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    offs = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(flat.max()) + 1, bool)
    links, joined = np.zeros(len(fps), np.int64), Sets()
    for i in range(len(fps) - 1):
        near = _agreement(sketched[i + 1 :], sketched[i]) >= PROPOSE
        if tile_x != tile_y:  # pairs inside a block belong to the block's own tile
            near &= where[i + 1 :] != where[i]
        near = np.flatnonzero(near) + i + 1
        if not len(near):
            continue
        mark[flat[offs[i] : offs[i + 1]]] = True
        if 4 * len(near) < len(fps) - i:
            common = np.array([mark[flat[offs[j] : offs[j + 1]]].sum() for j in near.tolist()])
        else:
            common = np.add.reduceat(mark[flat[offs[i + 1] :]], offs[i + 1 : -1] - offs[i + 1], dtype=np.int64)[near - i - 1]
        mark[flat[offs[i] : offs[i + 1]]] = False
        hits = near[(NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (size[i] + size[near])]
        links[i] += len(hits)
        links[hits] += 1
        for j in hits.tolist():
            joined.join(i, j)
    roots = [fps[joined.root(i)] for i in range(len(fps))]
    yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(links), pa.array(roots, pa.binary())], ["fp", "links", "root"])


def _address(text: str = "text") -> Column:
    return F.unhex(F.md5(text))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, the address of the text, and the class, root buckets and sketch (null without words) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialise(docs.select("doc_id", "text", _address().alias("at")).mapInArrow(_sketched, f"doc_id {kind}, at binary, fp binary, roots array<long>, sketch binary"))


def classes_of(rows: DataFrame) -> DataFrame:
    """A row for each class. One of its texts, by address, represents it; ids need not be unique, or there."""
    return materialise(rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("at").alias("at"), F.any_value("roots").alias("roots"), F.any_value("sketch").alias("sketch")))


def class_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (at, ...) with their texts; where they are few no other text is shuffled.

    Copies of a text are merged before the shuffle.
    """
    texts = docs.where("text is not null").select(_address().alias("at"), "text")
    if members.limit(FEW + 1).count() <= FEW:
        texts = texts.join(F.broadcast(members.select("at")), "at", "left_semi")
    return texts.groupBy("at").agg(F.any_value("text").alias("text")).join(members, "at")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links (other classes at the similarity or above) and group_id of every row."""
    rows = sketched(docs)
    classes = classes_of(rows)
    family = materialise(components(proposals(classes)))

    members = family.join(classes.select(F.col("fp").alias("node"), "at", "sketch"), "node")
    sizes = materialise(family.groupBy("root").agg(F.count("*").alias("n")))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    members = members.join(sizes, "root").withColumn("g", F.ceil(F.col("n") / TILE).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    # A block meets every block of its family: tiles (x, y) with x <= y.
    tiles = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")))
    members = materialise(members.select(F.col("node").alias("fp"), "root", "at", "sketch", "block", tiles.alias("tiles")))
    tiled = class_texts(docs, members).select("root", F.explode("tiles").alias("t"), "fp", "block", "sketch", "text").select("root", F.col("t.x").alias("x"), F.col("t.y").alias("y"), "fp", "block", "sketch", "text")
    exact = materialise(tiled.groupBy("root", "x", "y").applyInArrow(_exact, "fp binary, links long, root binary"))
    links = exact.groupBy("fp").agg(F.sum("links").alias("n_links"))
    if largest > TILE:
        group = components(exact.select(F.col("root").alias("a"), F.col("fp").alias("b"))).withColumnsRenamed({"node": "fp"})
    else:
        group = exact.select("fp", "root").where("fp <> root")
    found = classes.select("fp", "rep").join(links, "fp", "left").join(group, "fp", "left").select("fp", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "fp").alias("root"))
    found = materialise(found)
    # Both joins have a materialised table of a row for each key at one side, so Spark can split a hot group or class.
    named = materialise(found.groupBy("root").agg(F.min("rep").alias("group_id")))
    found = materialise(found.join(named, "root").select("fp", F.col("rep").alias("class_id"), "n_links", "group_id"))
    return rows.select("doc_id", "fp").join(found, "fp", "left").select(
        "doc_id",
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, same columns, with the row of the least id of each group only."""
    gone = join(docs).where("doc_id <> group_id").select("doc_id").distinct()
    docs, back = neutral(docs, ("doc_id",))
    return docs.join(gone, "doc_id", "left_anti").select(*back)
