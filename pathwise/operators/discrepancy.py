"""Discrepancy analysis and dissimilarity trees."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.operators.clustering import Draws, _classes, _sums_of_squares


@dataclass
class DiscrepancyResult:
    pseudo_r2: float
    pseudo_f: float
    p_value: float | None
    ss_total: float
    ss_within: float
    ss_between: float
    n_groups: int
    n_permutations: int


def _pseudo_f(total: float, within: float, n: int, k: int) -> float:
    if k - 1 <= 0 or n - k <= 0:
        return 0.0
    between = total - within
    if within <= 0:
        return math.inf if between > 0 else 0.0
    return (between / (k - 1)) / (within / (n - k))


def discrepancy_analysis(distance_matrix, labels, n_permutations: int = 0, random_state=None) -> DiscrepancyResult:
    """Share of the discrepancy that groups explain, with a permutation test."""
    d, labels = _classes(distance_matrix), np.asarray(labels)
    if len(labels) != len(d.of):
        raise ValueError(f"{len(labels)} labels for {len(d.of)} sequences")
    n, k = len(d.of), len(np.unique(labels))
    if n < 2:
        return DiscrepancyResult(0.0, 0.0, None, 0.0, 0.0, 0.0, k, n_permutations)
    total, within = _sums_of_squares(d, labels)
    f = _pseudo_f(total, within, n, k)
    if math.isinf(f):
        warnings.warn("no discrepancy within groups: pseudo-F is infinite", stacklevel=2)
    p = None
    if n_permutations:
        draws = random_state if isinstance(random_state, Draws) else Draws(random_state)
        least = f * (1 - 1e-9)  # a permutation that gives the same groups counts, whatever the order of its sums
        hits = sum(_pseudo_f(total, _sums_of_squares(d, labels[draws.order(n)])[1], n, k) >= least for _ in range(n_permutations))
        p = (hits + 1) / (n_permutations + 1)
    return DiscrepancyResult((total - within) / total if total > 0 else 0.0, f, p, total, within, total - within, k, n_permutations)


def multi_factor_discrepancy(distance_matrix, factors: dict, n_permutations: int = 0, random_state: int | None = None) -> dict[str, DiscrepancyResult]:
    """Each factor by itself; the permutations of one seed go on from factor to factor."""
    draws = Draws(random_state)
    return {k: discrepancy_analysis(distance_matrix, v, n_permutations, draws) for k, v in factors.items()}


def discrepancy_frame(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with the sums of squares, R2 and F, from a long table of distances and (id, cluster)."""
    la, lb = (labels.select(F.col("id").alias(f"id_{x}"), F.col("cluster").alias(f"c{x}")) for x in "ab")
    met = pairs.join(la, "id_a").join(lb, "id_b").withColumn("q", F.col("distance") * F.col("distance"))
    size = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    within = met.where("ca = cb").groupBy("ca").agg(F.sum("q").alias("s")).join(size, F.col("ca") == F.col("cluster")).agg(F.coalesce(F.sum(F.col("s") / F.col("n")), F.lit(0.0)).alias("ss_within"))
    sizes = size.agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    out = met.agg(F.sum("q").alias("q")).crossJoin(within).crossJoin(sizes)  # one row each
    out = out.select("n", "k", (F.col("q") / F.col("n")).alias("ss_total"), "ss_within").withColumn("ss_between", F.col("ss_total") - F.col("ss_within"))
    f = F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("ss_within") > 0), (F.col("ss_between") / F.greatest(F.col("k") - 1, F.lit(1))) / (F.greatest("ss_within", F.lit(1e-300)) / F.greatest(F.col("n") - F.col("k"), F.lit(1))))
    return out.select(F.col("k").alias("n_groups"), "ss_total", "ss_within", "ss_between", (F.col("ss_between") / F.col("ss_total")).alias("pseudo_r2"), F.coalesce(f, F.lit(0.0)).alias("pseudo_f"))


@dataclass
class DissTreeNode:
    indices: np.ndarray
    depth: int
    pseudo_r2: float = 0.0
    split_variable: str | None = None
    split_value: object = None
    left: DissTreeNode | None = None
    right: DissTreeNode | None = None

    @property
    def is_leaf(self) -> bool:
        return self.left is None

    @property
    def n_observations(self) -> int:
        return len(self.indices)


@dataclass
class DissTreeResult:
    root: DissTreeNode
    leaf_labels: np.ndarray
    n_leaves: int
    rows: list = field(default_factory=list)

    def to_dataframe(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "depth int, n int, is_leaf boolean, split_variable string, split_value string, pseudo_r2 double")


def _ss(d2: np.ndarray, of: np.ndarray) -> float:
    """Of sequences of the classes ``of``."""
    size = np.bincount(of, minlength=len(d2)).astype(float)
    return float(size @ d2 @ size / (2 * len(of))) if len(of) else 0.0


def dissimilarity_tree(distance_matrix, covariates, covariate_names=None, max_depth: int = 5, min_node_size: int = 5, min_r2_gain: float = 0.001) -> DissTreeResult:
    """Recursive splits on covariates that explain the most discrepancy of a node."""
    c = _classes(distance_matrix)
    d2, of = c.dense**2, c.of
    x = np.asarray(covariates)
    x = x[:, None] if x.ndim == 1 else x
    if len(x) != len(of):
        raise ValueError(f"{len(x)} rows of covariates for {len(of)} sequences")
    names = [f"x{k}" for k in range(x.shape[1])] if covariate_names is None else list(covariate_names)
    numeric = np.issubdtype(x.dtype, np.number)
    labels, rows, leaves = np.zeros(len(of), int), [], 0

    def cuts(column: np.ndarray):
        values = np.unique(column)
        for v in values[:-1] if numeric else values:
            yield v, (column <= v) if numeric else (column == v)

    def grow(index: np.ndarray, depth: int) -> DissTreeNode:
        nonlocal leaves
        node, total, best = DissTreeNode(index, depth), _ss(d2, of[index]), None
        if depth < max_depth and len(index) >= 2 * min_node_size and total > 0:
            for at in range(x.shape[1]):
                for v, left in cuts(x[index, at]):
                    if min(left.sum(), (~left).sum()) < min_node_size:
                        continue
                    gain = 1 - (_ss(d2, of[index[left]]) + _ss(d2, of[index[~left]])) / total
                    if gain > (best[0] if best else min_r2_gain):
                        best = gain, at, v, left
        at = len(rows)
        rows.append(None)
        if best:
            gain, by, v, left = best
            node.pseudo_r2, node.split_variable, node.split_value = gain, names[by], v.item() if hasattr(v, "item") else v
            node.left, node.right = grow(index[left], depth + 1), grow(index[~left], depth + 1)
        else:
            labels[index] = leaves
            leaves += 1
        rows[at] = (depth, len(index), node.is_leaf, node.split_variable, None if node.is_leaf else str(node.split_value), float(node.pseudo_r2))
        return node

    root = grow(np.arange(len(of)), 0)
    return DissTreeResult(root, labels, leaves, rows)
