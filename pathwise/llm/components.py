"""Connected components: edges contracted in their tasks, then alternating large-star and small-star steps.

The edges are dealt by one end, and a task replaces those it holds by stars of a union-find, so fewer edges
than it has nodes leave it, however many it was given. What is left is about as many edges as nodes. The
star steps are joins and aggregates. Each joins a table with a materialised one of a row for each key,
so Spark can split the rows of a hot node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.runtime import materialise

#: Nodes that a task holds at once; it sends their stars and starts anew beyond.
HELD = 1 << 20


class Sets:
    """Union-find whose roots are the least members."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, x, y) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def stars(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """An edge (a: root, b: node) for every node below a root; the sets are empty then."""
        nodes = [x for x in self.up if self.root(x) != x]
        for k in range(0, len(nodes), 50_000):
            part = nodes[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([self.root(x) for x in part], kind), pa.array(part, kind)], ["a", "b"])
        self.up.clear()


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (root, node) that connect what the edges of a task connect."""
    sets, kind = Sets(), None
    for batch in batches:
        kind = batch.schema.field(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.join(x, y)
        if len(sets.up) > HELD:
            yield from sets.stars(kind)
    yield from sets.stars(kind)


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a < b) that connect the same nodes as ``edges`` (a, b), materialised.

    b deals them: a may be a hub of any number of edges, b should be in a bounded number of them.
    """
    kind = f"a {edges.schema['a'].dataType.simpleString()}, b {edges.schema['b'].dataType.simpleString()}"
    return materialise(edges.select("a", "b").repartition("b").mapInArrow(_stars, kind))


def _settled(edges: DataFrame) -> bool:
    """Whether every node below a root hangs on that root alone."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("top"), F.lit(0).alias("low")), F.struct(F.col("b").alias("x"), F.lit(0).alias("top"), F.lit(1).alias("low")))).alias("e"))
    nodes = ends.groupBy("e.x").agg(F.max("e.top").alias("top"), F.sum("e.low").alias("low"))
    return not nodes.where("low > 1 or (low = 1 and top = 1)").take(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b); the root is the least node of the component.

    Loops and repeated edges do no harm. A star step at most halves the depth of a component, so a few
    rounds settle any graph; they go on until nothing changes.
    """
    edges = contracted(edges.where("a <> b"))
    while not _settled(edges):
        # Large star: every neighbour above a node is linked to the node's least neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m")))
        large = materialise(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct())
        # Small star: a node and its lower neighbours are linked to the least of them.
        least = materialise(large.groupBy("b").agg(F.min("a").alias("m")))
        ends = F.when(F.col("a") == F.col("m"), F.array("b")).otherwise(F.array("a", "b"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(ends).alias("b"))
        edges = materialise(small.distinct())
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
