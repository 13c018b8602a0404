"""Medoid and hierarchical clustering, and what describes a clustering.

Medoid search and linkage work on a dense matrix of the different sequences on the driver, each with the number
of its copies, and suit a few thousand different sequences. The results are those for all sequences, ties
included. CLARA is the way beyond: given a pool, it computes distances within samples and from all sequences
to the medoids only. Quality and representatives also have forms over the long table of distances, and over a
pool's distances, where they weigh pairs of different sequences and no pair of ids is made.
"""

from __future__ import annotations

import hashlib
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.functions.model import drawn_ids
from pathwise.functions.runtime import materialise
from pathwise.operators.distances import Classes, DistanceMatrix, class_median, class_sums, placed


def _classes(x) -> Classes:
    return DistanceMatrix.coerce(x).classes


def _labels_of(x, sequence_ids, n: int) -> list:
    ids = sequence_ids if sequence_ids is not None else getattr(x, "labels", None)
    ids = list(range(n)) if ids is None else list(ids)
    if len(ids) != n:
        raise ValueError(f"{len(ids)} sequence ids for {n} sequences")
    return ids


def frame(spark, columns: dict) -> DataFrame:
    """A DataFrame of whole columns (lists or arrays), sent to Spark as Arrow and not row by row."""
    return spark.createDataFrame(pa.table({k: pa.array(v, None if len(v) or isinstance(v, np.ndarray) else pa.int64()) for k, v in columns.items()}))


@dataclass
class ClusteringResult:
    labels: np.ndarray
    sequence_ids: list
    n_clusters: int

    @property
    def cluster_sizes(self) -> dict[int, int]:
        return {int(k): int(n) for k, n in zip(*np.unique(self.labels, return_counts=True), strict=True)}

    def get_cluster_members(self, cluster: int) -> list:
        return [s for s, k in zip(self.sequence_ids, self.labels, strict=True) if k == cluster]

    def rows(self) -> list[tuple]:
        return [(s, int(k)) for s, k in zip(self.sequence_ids, self.labels, strict=True)]

    def to_dataframe(self, spark) -> DataFrame:
        return frame(spark, {"id": self.sequence_ids, "cluster": self.labels.astype(np.int32)})


@dataclass
class PAMClusteringResult(ClusteringResult):
    medoid_indices: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    total_cost: float = 0.0
    n_iterations: int = 0

    def get_medoid_ids(self) -> list:
        return [self.sequence_ids[i] for i in self.medoid_indices]

    def to_dataframe(self, spark) -> DataFrame:
        is_medoid = np.zeros(len(self.labels), bool)
        is_medoid[self.medoid_indices] = True
        return frame(spark, {"id": self.sequence_ids, "cluster": self.labels.astype(np.int32), "is_medoid": is_medoid})


@dataclass
class CLARAClusteringResult(PAMClusteringResult):
    sample_costs: list = field(default_factory=list)


@dataclass
class HierarchicalClusteringResult(ClusteringResult):
    linkage_matrix: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    method: str = "ward"


def _initial(c: Classes, k: int, init: str, rng: np.random.Generator) -> list[int]:
    """The places of the first medoids."""
    d, of, size, n = c.dense, c.of, c.size, len(c.of)
    if init == "random":
        return sorted(rng.choice(n, k, replace=False).tolist())
    if init == "k-medoids++":
        out = [int(rng.integers(n))]
        while len(out) < k:
            near = d[:, of[out]].min(1)[of] ** 2
            near[out] = 0
            free = np.setdiff1d(np.arange(n), out)
            out.append(int(rng.choice(n, p=near / near.sum()) if near.sum() > 0 else rng.choice(free)))
        return out
    if init != "build":
        raise ValueError(f"Unknown init: {init!r}")
    out = [int(c.first[(d @ size).argmin()])]
    near = d[:, of[out[0]]].copy()
    while len(out) < k:
        gain = np.maximum(near[None, :] - d, 0) @ size
        free = _first_free(c, out)
        gain[free == n] = -np.inf
        best = np.flatnonzero(gain == gain.max())
        out.append(int(free[best].min()))
        near = np.minimum(near, d[:, of[out[-1]]])
    return out


def _first_free(c: Classes, taken: list[int]) -> np.ndarray:
    """The least place of each class that is not taken, or the number of places."""
    out = c.first.copy()
    for u in {int(c.of[x]) for x in taken}:
        left = np.setdiff1d(np.flatnonzero(c.of == u), taken)
        out[u] = left[0] if len(left) else len(c.of)
    return out


def _swaps(c: Classes, medoids: list[int]) -> np.ndarray:
    """The total cost after each swap of medoid m (row) by a member of a class (column)."""
    d, size = c.dense, c.size
    to = d[:, c.of[medoids]]
    order = np.argsort(to, axis=1, kind="stable")
    near, owner = to[np.arange(len(d)), order[:, 0]], order[:, 0]
    second = to[np.arange(len(d)), order[:, 1]] if len(medoids) > 1 else np.full(len(d), np.inf)
    out = np.empty((len(medoids), len(d)))
    for m in range(len(medoids)):
        left = np.where(owner == m, second, near)
        out[m] = size @ np.minimum(left[:, None], d)
    return out


def pam_clustering(distance_matrix, n_clusters: int, max_iter: int = 100, init: str = "build", random_state: int | None = None, sequence_ids=None) -> PAMClusteringResult:
    """Partitioning around medoids: the best of all swaps is taken while it lowers the cost."""
    dm = DistanceMatrix.coerce(distance_matrix)
    c = dm.classes
    n = len(c.of)
    if n_clusters > n:
        raise ValueError(f"{n_clusters} clusters of {n} sequences")
    ids = _labels_of(dm, sequence_ids, n)
    medoids = _initial(c, n_clusters, init, np.random.default_rng(random_state))
    cost, rounds = c.size @ c.dense[:, c.of[medoids]].min(1), 0
    for _ in range(max_iter):
        rounds += 1
        after, free = _swaps(c, medoids), _first_free(c, medoids)
        after[:, free == n] = np.inf
        least = after.min()
        if not least < cost:
            break
        m = int(np.flatnonzero((after == least).any(1))[0])
        x = int(free[after[m] == least].min())
        medoids[m], cost = x, least
    to = c.dense[:, c.of[medoids]]
    return PAMClusteringResult(to.argmin(1)[c.of], ids, n_clusters, np.array(medoids), float(c.size @ to.min(1)), rounds + 1)


class PAMClustering:
    def __init__(self, n_clusters: int = 3, max_iter: int = 100, init: str = "build", random_state: int | None = None) -> None:
        self.n_clusters, self.max_iter, self.init, self.random_state, self.result = n_clusters, max_iter, init, random_state, None

    def fit(self, distance_matrix, sequence_ids=None) -> PAMClustering:
        self.result = pam_clustering(distance_matrix, self.n_clusters, self.max_iter, self.init, self.random_state, sequence_ids)
        return self

    @property
    def labels_(self) -> np.ndarray:
        return self._fitted().labels

    def _fitted(self) -> PAMClusteringResult:
        if self.result is None:
            raise ValueError("not fitted yet")
        return self.result

    def predict(self, distances) -> np.ndarray:
        """The nearest medoid of new sequences, from their distances to all the fitted ones, or of the sequences of a DistanceMatrix with the fitted ids."""
        r = self._fitted()
        if isinstance(distances, DistanceMatrix):
            c = distances.classes
            if len(c.of) != len(r.labels):
                raise ValueError(f"distances to {len(r.labels)} fitted sequences are needed")
            return c.dense[:, c.of[r.medoid_indices]].argmin(1)[c.of]
        x = np.asarray(distances, float)
        if x.ndim != 2 or x.shape[1] != len(r.labels):
            raise ValueError(f"distances to {len(r.labels)} fitted sequences are needed")
        return x[:, r.medoid_indices].argmin(1)


class Draws:
    """Random orders of 0..n-1 by the MD5 of seed, number of the draw and place, so that they can be drawn anywhere again."""

    def __init__(self, seed=None) -> None:
        if isinstance(seed, np.random.Generator):
            seed = seed.integers(1 << 62)
        self.seed, self.drawn = int(np.random.default_rng().integers(1 << 62)) if seed is None else int(seed), 0

    def order(self, n: int) -> np.ndarray:
        start = hashlib.md5(f"{self.seed}:{self.drawn}:".encode())
        keys = bytearray()
        for i in range(n):
            key = start.copy()
            key.update(b"%d" % i)
            keys += key.digest()
        self.drawn += 1
        high, low = np.frombuffer(bytes(keys), ">u8").reshape(-1, 2).astype(np.uint64).T
        return np.lexsort((low, high))


def clara_clustering(distance_matrix, n_clusters: int, n_samples: int = 5, sample_size: int | None = None, max_iter: int = 100, random_state: int | None = None, sequence_ids=None) -> CLARAClusteringResult:
    """PAM on samples; the medoids that suit all sequences best are kept."""
    dm = DistanceMatrix.coerce(distance_matrix)
    c = dm.classes
    n = len(c.of)
    ids = _labels_of(dm, sequence_ids, n)
    if n_clusters > n:
        raise ValueError(f"{n_clusters} clusters of {n} sequences")
    size = min(sample_size or 40 + 2 * n_clusters, n)
    draws, best, costs = Draws(random_state), None, []
    for _ in range(n_samples):
        s = np.sort(draws.order(n)[:size])
        r = pam_clustering(c.dense[np.ix_(c.of[s], c.of[s])], min(n_clusters, size), max_iter)
        medoids = s[r.medoid_indices]
        cost = float(c.size @ c.dense[:, c.of[medoids]].min(1))
        costs.append(cost)
        if best is None or cost < best[0]:
            best = cost, medoids, r.n_iterations
    cost, medoids, rounds = best
    return CLARAClusteringResult(c.dense[:, c.of[medoids]].argmin(1)[c.of], ids, n_clusters, medoids, cost, rounds, costs)


def clara_pool(pool, n_clusters: int, method: str = "om", n_samples: int = 5, sample_size: int | None = None, seed: int = 0, **options) -> tuple[DataFrame, list]:
    """CLARA without the full matrix: (id, cluster, distance) of every sequence, and the medoid ids.

    Only samples of a fixed size reach the driver, drawn by the MD5 of seed and id and read in one scan. All
    sequences meet the medoids, a broadcast of n_samples * n_clusters sequences, in another. Sequences
    without an id are left out; a null state is one more state.
    """
    from pathwise.operators.distances import coded
    from pathwise.operators.kernels import KERNELS, Batch

    kernel, (seqs, k, *_) = KERNELS[method], coded(pool)
    size = sample_size or 40 + 2 * n_clusters
    ids = materialise(seqs.select("id"))
    chosen = [[r.id for r in drawn_ids(ids, size, seed + s).collect()] for s in range(n_samples)]
    wanted = pool.spark.createDataFrame([(x,) for x in sorted({x for c in chosen for x in c})], ids.schema)
    codes_of = {r.id: np.array(r.codes, np.int64) for r in seqs.join(F.broadcast(wanted), "id").select("id", "codes").collect()}
    medoids: list[tuple[int, int, object, np.ndarray]] = []
    for s in range(n_samples):
        drawn = sorted(chosen[s])
        codes = [codes_of[x] for x in drawn]
        i, j = np.triu_indices(len(codes), 1)
        values = kernel(Batch([codes[x] for x in i], [codes[y] for y in j]), k, **options) if len(i) else np.zeros(0)
        r = pam_clustering(DistanceMatrix.from_condensed(values) if len(codes) > 1 else np.zeros((len(codes),) * 2), min(n_clusters, len(codes)))
        medoids += [(s, c, drawn[m], codes[m]) for c, m in enumerate(r.medoid_indices)]
    kind = pool.base.schema["id"].dataType.simpleString()

    def near(batches):
        import pyarrow as pa

        for b in batches:
            own = [np.array(c, np.int64) for c in b.column(1).to_pylist()]
            ids, out = b.column(0), []
            for s in range(n_samples):
                mine = [m for m in medoids if m[0] == s]
                d = np.stack([kernel(Batch(own, [m[3]] * len(own)), k, **options) for m in mine]) if own else np.zeros((1, 0))
                out.append((d.argmin(0), d.min(0)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([list(map(int, x)) for x in zip(*(o[0] for o in out))], pa.list_(pa.int32())), pa.array([list(map(float, x)) for x in zip(*(o[1] for o in out))], pa.list_(pa.float64()))], ["id", "c", "d"])

    scored = materialise(seqs.select("id", "codes").mapInArrow(near, f"id {kind}, c array<int>, d array<double>"))
    costs = scored.agg(*(F.sum(F.col("d")[s]).alias(f"s{s}") for s in range(n_samples))).first()
    best = min(range(n_samples), key=lambda s: costs[s])
    return scored.select("id", F.col("c")[best].alias("cluster"), F.col("d")[best].alias("distance")), [m[2] for m in medoids if m[0] == best]


def _merged(x: np.ndarray, y: np.ndarray, i: float, j: float, size: np.ndarray, h: float, method: str) -> np.ndarray:
    """Lance-Williams: distances of the union of clusters of i and j members, h apart, from their distances x and y."""
    if method == "single":
        return np.minimum(x, y)
    if method == "complete":
        return np.maximum(x, y)
    if method == "average":
        return (i * x + j * y) / (i + j)
    total = i + j + size
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.maximum(0.0, ((i + size) * (x * x) + (j + size) * (y * y) - size * (h * h)) / total))


def _copies(c: Classes, method: str) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """What linkage does first, as copies are 0 apart: distances of the classes as clusters, their names, the merges."""
    d, n, size = c.dense.astype(float).copy(), len(c.of), np.ones(len(c.size))
    name, out = c.first.copy(), []
    places = np.split(np.argsort(c.of, kind="stable"), np.cumsum(c.size.astype(int))[:-1]) if len(c.size) else []
    for u, members in enumerate(places):
        x, y = d[u].copy(), d[u].copy()
        for k, place in enumerate(members[1:].tolist(), 1):
            out.append((*sorted((int(name[u]), place)), 0.0, k + 1))
            name[u] = n + len(out) - 1
            if method in ("average", "ward"):  # copy by copy, for the same roundings as without classes
                x = _merged(x, y, float(k), 1.0, size, 0.0, method)
                x[u] = 0.0
        d[u], d[:, u], size[u] = x, x, len(members)
    return d, name, out


def _linkage(d: np.ndarray | Classes, method: str) -> np.ndarray:
    """Merges (a, b, height, size) in order of height, by Lance-Williams updates.

    A cluster stands at the place of its least member; of equal heights the least places merge first.
    """
    if not isinstance(d, Classes):
        d = Classes(d, np.arange(len(d)), np.ones(len(d)))
    total, size = len(d.of), d.size.copy()
    d, name, out = _copies(d, method)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    near = d.argmin(1) if n > 1 else np.zeros(n, int)
    for _ in range(n - 1):
        best = np.where(alive, d[np.arange(n), near], np.inf)
        i = int(best.argmin())
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        h, a, b = d[i, j], *sorted((name[i], name[j]))
        out.append((a, b, h, size[i] + size[j]))
        new = np.where(alive, _merged(d[i], d[j], size[i], size[j], size, h, method), np.inf)
        new[[i, j]] = np.inf
        alive[j] = False
        d[j], d[:, j] = np.inf, np.inf
        d[i], d[:, i] = new, new
        size[i] += size[j]
        name[i] = total + len(out) - 1
        stale = np.flatnonzero(alive & ((near == i) | (near == j) | (np.arange(n) == i)))
        near[stale] = d[stale].argmin(1)
        now = d[np.arange(n), near]
        closer = alive & ((d[:, i] < now) | ((d[:, i] == now) & (i < near)))
        near[closer] = i
    return np.array(out, float).reshape(-1, 4)


def _cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """At most k clusters: the lowest height at which no more remain. Numbered along the tree, left to right."""
    if n == 0:
        return np.zeros(0, int)
    heights = np.maximum.accumulate(merges[:, 2]) if len(merges) else np.zeros(0)
    need = n - k
    limit = heights[need - 1] if need > 0 else -np.inf
    labels, nxt = np.zeros(n, int), 0
    todo = [(2 * n - 2, None)]
    while todo:
        node, own = todo.pop()
        if own is None and (node < n or heights[node - n] <= limit):
            own, nxt = nxt, nxt + 1
        if node < n:
            labels[node] = own
        else:
            a, b = int(merges[node - n, 0]), int(merges[node - n, 1])
            todo += [(b, own), (a, own)]
    return labels


def hierarchical_clustering(distance_matrix, n_clusters: int, method: str = "ward", sequence_ids=None) -> HierarchicalClusteringResult:
    """Agglomerative clustering cut to at most n_clusters (ties in height may give fewer)."""
    if method not in ("ward", "complete", "average", "single"):
        raise ValueError(f"Unknown method: {method!r}")
    dm = DistanceMatrix.coerce(distance_matrix)
    c = dm.classes
    if ((c.dense == 0).sum() > len(c.dense)) and len(c.dense) < len(c.of):  # unlike sequences may merge before copies do
        c = Classes(dm.values, np.arange(len(c.of)), np.ones(len(c.of)))
    ids = _labels_of(dm, sequence_ids, len(c.of))
    merges = _linkage(Classes((c.dense + c.dense.T) / 2, c.of, c.size), method)
    return HierarchicalClusteringResult(_cut(merges, len(c.of), n_clusters), ids, n_clusters, merges, method)


class HierarchicalClustering:
    def __init__(self, n_clusters: int = 3, method: str = "ward") -> None:
        self.n_clusters, self.method, self.result = n_clusters, method, None

    def fit(self, distance_matrix, sequence_ids=None) -> HierarchicalClustering:
        self.result = hierarchical_clustering(distance_matrix, self.n_clusters, self.method, sequence_ids)
        return self

    @property
    def labels_(self) -> np.ndarray:
        if self.result is None:
            raise ValueError("not fitted yet")
        return self.result.labels


# --- quality on the driver -------------------------------------------------------------------------


def _counts(c: Classes, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of each class in each cluster, and each place's cluster."""
    names, own = np.unique(labels, return_inverse=True)
    shape = len(c.dense), len(names)
    return np.bincount(c.of * shape[1] + own, minlength=shape[0] * shape[1]).reshape(shape).astype(float), own


def _to_clusters(c: Classes, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each class's sums of distances to each cluster, the places' own clusters, cluster sizes."""
    counts, own = _counts(c, labels)
    return c.dense @ counts, own, counts.sum(0)


def silhouette_scores(distance_matrix, labels) -> np.ndarray:
    """(b - a) / max(a, b); the only member of a cluster has a = 0."""
    c, labels = _classes(distance_matrix), np.asarray(labels)
    sums, own, size = _to_clusters(c, labels)
    n, k = len(c.of), len(size)
    if k <= 1 or k >= n:
        return np.zeros(n)
    row = np.arange(n)
    a = sums[c.of, own] / np.maximum(size[own] - 1, 1)
    means = (sums / size)[c.of]
    means[row, own] = np.inf
    b = means.min(1)
    top = np.maximum(a, b)
    return np.divide(b - a, top, out=np.zeros(n), where=top > 0)


def silhouette_score(distance_matrix, labels) -> float:
    s = silhouette_scores(distance_matrix, labels)
    return float(s.mean()) if len(s) else 0.0


def _sums_of_squares(c: Classes, labels: np.ndarray) -> tuple[float, float]:
    """Total and within-cluster sums of squares."""
    counts, _ = _counts(c, labels)
    d2 = c.dense**2
    return float(c.size @ d2 @ c.size / (2 * len(c.of))), float(((counts * (d2 @ counts)).sum(0) / (2 * counts.sum(0))).sum())


def cluster_quality(distance_matrix, labels) -> dict[str, float]:
    c, labels = _classes(distance_matrix), np.asarray(labels)
    counts, _ = _counts(c, labels)
    # Weights of the ordered pairs of classes, and of those in one cluster, without a sequence and itself.
    every, same = np.outer(c.size, c.size) - np.diag(c.size), counts @ counts.T - np.diag(c.size)
    pairs, alike, pbc = every.sum(), same.sum(), 0.0
    if pairs and 0 < alike < pairs:
        gap, share = c.dense - (every * c.dense).sum() / pairs, alike / pairs
        spread = (every * gap * gap).sum() / pairs
        pbc = float((same * gap).sum() / pairs / np.sqrt(spread * share * (1 - share))) if spread > 0 else 0.0
    total, within = _sums_of_squares(c, labels)
    return {"ASW": silhouette_score(distance_matrix, labels), "PBC": pbc, "HG": -pbc, "R2": 1 - within / total if total > 0 else 0.0}


def distance_to_center(distance_matrix, labels) -> np.ndarray:
    c = _classes(distance_matrix)
    sums, own, size = _to_clusters(c, np.asarray(labels))
    return sums[c.of, own] / np.maximum(size[own] - 1, 1)


def k_range(start: int, end: int) -> list[int]:
    return list(range(start, end + 1))


def pam_range(distance_matrix, k_values=None, max_iter: int = 100, init: str = "build", *, k_range=None) -> list[dict]:
    """Quality, cost and rounds of PAM for several cluster counts."""
    d = DistanceMatrix.coerce(distance_matrix)
    n = len(d.classes.of)
    if k_range is not None:
        if k_values is not None:
            raise TypeError("give k_values or k_range, not both")
        k_values = k_range
    if k_values is None:
        k_values = range(2, min(n - 1, 10) + 1)
    elif isinstance(k_values, tuple) and len(k_values) == 2:
        warnings.warn("a tuple of two is an inclusive range; use k_range()", DeprecationWarning, stacklevel=2)
        k_values = range(k_values[0], k_values[1] + 1)
    out = []
    for k in k_values:
        if 2 <= k < n:
            r = pam_clustering(d, k, max_iter, init)
            out.append({"k": k, **cluster_quality(d, r.labels), "total_cost": r.total_cost, "n_iterations": r.n_iterations})
    return out


@dataclass
class RepresentativeResult:
    indices: np.ndarray
    scores: np.ndarray
    strategy: str
    cluster_labels: np.ndarray | None = None


def _median_distance(d: np.ndarray, size: np.ndarray) -> float:
    """The median over all pairs of the classes' members, of which there are ``size``."""
    i, j = np.triu_indices(len(d))
    weight = np.where(i == j, size[i] * (size[i] - 1) / 2, size[i] * size[j])
    order = np.argsort(d[i, j], kind="stable")
    upto, x = np.cumsum(weight[order]), d[i, j][order]
    if not len(upto) or not upto[-1]:
        return 0.0
    low, high = (x[np.searchsorted(upto, at, "right")] for at in ((upto[-1] - 1) // 2, upto[-1] // 2))
    return float((low + high) / 2)


def extract_representatives(distance_matrix, n_representatives: int = 4, strategy: str = "centrality", labels=None) -> RepresentativeResult:
    """Indices of typical sequences, by cluster if labels are given."""
    c = _classes(distance_matrix)
    d = c.dense

    def pick(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.bincount(c.of[rows], minlength=len(d)).astype(float)
        if strategy == "centrality":
            score = -(d @ size)
        elif strategy == "frequency":
            score = ((d > 0) & (d <= _median_distance(d, size))).astype(float) @ size
        elif strategy == "density":
            radius = _median_distance(d, size)
            score = np.exp(-0.5 * (d / (radius if radius > 0 else 1.0)) ** 2) @ size
        else:
            raise ValueError(f"Unknown strategy: {strategy!r}")
        score = score[c.of[rows]]
        top = np.argsort(-score, kind="stable")[:k]
        return rows[top], np.abs(score[top])

    if labels is None:
        idx, score = pick(np.arange(len(c.of)), n_representatives)
        return RepresentativeResult(idx, score, strategy)
    labels = np.asarray(labels)
    names = np.unique(labels)
    each, more = divmod(n_representatives, len(names))
    parts = [pick(np.flatnonzero(labels == c), each + (k < more)) for k, c in enumerate(names)]
    idx = np.concatenate([p[0] for p in parts])
    return RepresentativeResult(idx, np.concatenate([p[1] for p in parts]), strategy, labels[idx])


# --- the same over long tables ---------------------------------------------------------------------


def both_ways(pairs: DataFrame) -> DataFrame:
    """(i, j, d) for both orders of each pair."""
    a, b = F.col("id_a"), F.col("id_b")
    ends = F.array(F.struct(a.alias("i"), b.alias("j")), F.struct(b.alias("i"), a.alias("j")))
    return pairs.select(F.explode(ends).alias("e"), F.col("distance").alias("d")).select("e.i", "e.j", "d")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """both_ways with the clusters ci and cj; ``labels`` is (id, cluster)."""
    li, lj = (labels.select(F.col("id").alias(x), F.col("cluster").alias(f"c{x}")) for x in ("i", "j"))
    return both_ways(pairs).join(li, "i").join(lj, "j")


def silhouette_frame(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, cluster, silhouette); every cluster count from 2 to n - 1."""
    size = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    sums = _labelled(pairs, labels).groupBy("i", "ci", "cj").agg(F.sum("d").alias("s"))
    return _silhouettes(sums, size, "i", "ci").select(F.col("i").alias("id"), F.col("ci").alias("cluster"), "silhouette")


def _silhouettes(sums: DataFrame, size: DataFrame, *by: str) -> DataFrame:
    """(by, silhouette) from sums s of distances to clusters cj and the clusters' sizes (cluster, n)."""
    per = sums.join(F.broadcast(size), F.col("cj") == F.col("cluster")).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("ci") == F.col("cj"), F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))), F.lit(0.0)).alias("a"),
        F.min(F.when(F.col("ci") != F.col("cj"), F.col("s") / F.col("n"))).alias("b"),
    )
    top = F.greatest("a", "b")
    return per.select(*by, F.when(top > 0, (F.col("b") - F.col("a")) / F.greatest(top, F.lit(1e-300))).otherwise(0.0).alias("silhouette"))


def distance_to_center_frame(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    own = _labelled(pairs, labels).where("ci = cj").groupBy("i").agg(F.avg("d").alias("d"))
    return labels.join(own, labels["id"] == own["i"], "left").select("id", "cluster", F.coalesce("d", F.lit(0.0)).alias("distance_to_center"))


def _classed(dm: DistanceMatrix, labels: DataFrame) -> tuple[DataFrame, int]:
    """Different sequences (place, codes, clusters) with the numbers of their copies in each cluster, and how many they are."""
    counts = dm.source.seqs.join(labels, "id").groupBy("codes", "cluster").agg(F.count("*").alias("n"))
    classes = placed(counts.groupBy("codes").agg(F.collect_list(F.struct("cluster", "n")).alias("clusters")), "codes")
    return classes, classes.count()


def _sums_to_clusters(dm: DistanceMatrix, labels: DataFrame) -> DataFrame:
    """(place, ci, w, cj, s, q): a class's w members in cluster ci, each one's sums of distances and of their squares to cj."""
    classes, n = _classed(dm, labels)
    sums = class_sums(classes.select("place", "codes", "clusters"), n, dm.source.pairwise, lambda d: [d, d * d], ["s", "q"])
    own = classes.select("place", F.explode("clusters").alias("own")).select("place", F.col("own.cluster").alias("ci"), F.col("own.n").alias("w"))
    return own.join(sums.withColumnRenamed("cluster", "cj"), "place")


def cluster_quality_frame(pairs: DataFrame | DistanceMatrix, labels: DataFrame) -> DataFrame:
    """One row: asw, pbc, hg, r2, from a long table or a pool's distances; no pair of ids is made for the latter, and none written."""
    size = materialise(labels.groupBy("cluster").agg(F.count("*").alias("n")))
    if isinstance(pairs, DistanceMatrix) and pairs.source is not None and pairs.source.metric:
        sums = materialise(_sums_to_clusters(pairs, labels))
        weight, by = F.col("w"), ("place", "ci", "w")
    else:
        met = _labelled(pairs.pairs if isinstance(pairs, DistanceMatrix) else pairs, labels)
        sums = materialise(met.groupBy("i", "ci", "cj").agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q")))
        weight, by = F.lit(1), ("i", "ci")
    same = F.col("ci") == F.col("cj")
    n = size.agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    inside = F.when(same, weight * F.col("q") / 2 / F.col("n"))
    whole = sums.join(F.broadcast(size), F.col("ci") == F.col("cluster")).agg(F.sum(weight * F.col("s") / 2).alias("d"), F.sum(weight * F.col("q") / 2).alias("q"), F.sum(F.when(same, weight * F.col("s") / 2)).alias("ds"), F.sum(inside).alias("within"))
    asw = _silhouettes(sums, size, *by).agg((F.sum(weight * F.col("silhouette")) / F.sum(F.when(F.col("silhouette").isNotNull(), weight))).alias("asw"))
    pairs_ = F.col("n") * (F.col("n") - 1) / 2
    d, share = F.col("d") / pairs_, F.col("same") / pairs_
    spread = (F.col("q") / pairs_ - d * d) * share * (1 - share)
    out = whole.crossJoin(n).crossJoin(asw).withColumn("some", F.col("n") > 1)  # one row each
    pbc = F.when(F.col("some"), F.when(spread > 0, (F.coalesce("ds", F.lit(0.0)) / pairs_ - d * share) / F.sqrt(spread)))
    r2 = F.when(F.col("some"), F.when(F.col("q") > 0, 1 - F.coalesce("within", F.lit(0.0)) / (F.col("q") / F.col("n"))))
    return out.select(F.when(F.col("some"), F.col("asw")).alias("asw"), pbc.alias("pbc"), (-pbc).alias("hg"), r2.alias("r2"))


def representatives_frame(pairs: DataFrame | DistanceMatrix, strategy: str = "centrality", n: int = 4) -> DataFrame:
    """The n most typical ids with their scores, from a long table or a pool's distances; no pair of ids is made for the latter."""
    if strategy not in ("centrality", "frequency", "density"):
        raise ValueError(f"Unknown strategy: {strategy!r}")
    order = F.asc("score") if strategy == "centrality" else F.desc("score")
    if isinstance(pairs, DistanceMatrix) and pairs.source is not None and pairs.source.metric:
        scores = _scores_of_classes(pairs, strategy)
    else:
        scores = _scores_of_pairs(pairs.pairs if isinstance(pairs, DistanceMatrix) else pairs, strategy)
    return scores.select("id", F.round("score", 9).alias("score")).orderBy(order, "id").limit(n)


def _scores_of_classes(dm: DistanceMatrix, strategy: str) -> DataFrame:
    """(id, score); a sequence's copies share the sums over its class."""
    seqs = dm.source.seqs
    classes, n = _classed(dm, seqs.select("id", F.lit(0).alias("cluster")))
    classes = classes.select("place", "codes", "clusters")
    if strategy == "centrality":
        weigh = lambda d: [d]
    else:
        h = class_median(classes, n, dm.source.pairwise)
        weigh = (lambda d: [((d > 0) & (d <= h)).astype(float)]) if strategy == "frequency" else (lambda d: [np.exp(-0.5 * (d / (h if h > 0 else 1.0)) ** 2)])
    sums = class_sums(classes, n, dm.source.pairwise, weigh, ["score"]).select("place", "score")
    scored = classes.join(sums, "place").where((F.lit(n) > 1) | (F.col("clusters")[0]["n"] > 1))  # a sequence alone has no pairs
    return seqs.join(scored.select("codes", "score"), "codes").select("id", "score")


def _scores_of_pairs(pairs: DataFrame, strategy: str) -> DataFrame:
    rows = both_ways(pairs)
    if strategy == "centrality":
        scores = rows.groupBy("i").agg(F.sum("d").alias("score"))
    else:
        rows = rows.crossJoin(F.broadcast(pairs.agg(F.percentile("distance", F.lit(0.5)).alias("h"))))  # one row
        if strategy == "frequency":
            scores = rows.groupBy("i").agg(F.sum(((F.col("d") > 0) & (F.col("d") <= F.col("h"))).cast("double")).alias("score"))
        else:
            h = F.when(F.col("h") > 0, F.col("h")).otherwise(1.0)
            scores = rows.groupBy("i").agg((F.sum(F.exp(-0.5 * F.pow(F.col("d") / h, F.lit(2.0)))) + 1).alias("score"))
    return scores.withColumnRenamed("i", "id")
