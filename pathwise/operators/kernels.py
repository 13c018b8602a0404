"""Dynamic programmes over many pairs of sequences at once.

A batch holds P pairs as padded code matrices. A sweep fills the table cell by cell, each cell being a
vector over the P pairs, and picks every pair's own corner, so Python's cost is per cell, not per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class Batch:
    """Pairs (a[k], b[k]) as padded codes: codes[i, k] is element i of pair k."""

    def __init__(self, a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> None:
        self.la, self.lb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
        self.a, self.b = self._padded(a, self.la), self._padded(b, self.lb)

    @staticmethod
    def _padded(x: Sequence[np.ndarray], size: np.ndarray) -> np.ndarray:
        out = np.zeros((int(size.max(initial=0)), len(x)), np.int64)
        for k, s in enumerate(x):
            out[: len(s), k] = s
        return out

    @property
    def longest(self) -> np.ndarray:
        return np.maximum(self.la, self.lb)


Cell = Callable[[int, int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _sweep(t: Batch, top: np.ndarray, side: np.ndarray, cell: Cell) -> np.ndarray:
    """Each pair's corner of the table with first row ``top`` and first column ``side`` (index by pair)."""
    n, m, pairs = len(t.a), len(t.b), np.arange(len(t.la))
    out = np.array(top[t.lb, pairs], float)
    above = top
    for i in range(1, n + 1):
        row = np.empty_like(above)
        row[0] = side[i]
        for j in range(1, m + 1):
            row[j] = cell(i, j, above[j - 1], above[j], row[j - 1])
        ends = np.flatnonzero(t.la == i)
        out[ends] = row[t.lb[ends], ends]
        above = row
    return out


def _ramp(n: int, p: int, step: float) -> np.ndarray:
    return np.repeat(np.arange(n + 1, dtype=float)[:, None] * step, p, axis=1)


def _wall(n: int, p: int) -> np.ndarray:
    out = np.full((n + 1, p), np.inf)
    out[0] = 0.0
    return out


def cost_table(sm, n_states: int, sub_cost: float) -> np.ndarray:
    """A cost matrix from a name or an array; a larger array is fine."""
    if isinstance(sm, str):
        if sm == "constant":
            out = np.full((n_states, n_states), float(sub_cost))
        elif sm == "binary":
            out = np.ones((n_states, n_states))
        elif sm == "squared":
            k = np.arange(n_states, dtype=float)
            return (k[:, None] - k[None, :]) ** 2
        else:
            raise ValueError(f"Unknown substitution method: {sm!r}")
        np.fill_diagonal(out, 0.0)
        return out
    out = np.asarray(sm, float)
    if out.ndim != 2 or out.shape[0] != out.shape[1]:
        raise ValueError("the substitution matrix must be square")
    if out.shape[0] < n_states:
        raise ValueError(f"the substitution matrix is too small for {n_states} states")
    return out


def _edit(t: Batch, indel: float, sub: Callable[[int, int], np.ndarray]) -> np.ndarray:
    def cell(i, j, diag, up, left):
        return np.minimum(np.minimum(up, left) + indel, diag + sub(i - 1, j - 1))

    p = len(t.la)
    return _sweep(t, _ramp(len(t.b), p, indel), _ramp(len(t.a), p, indel), cell)


def _over(x: np.ndarray, size: np.ndarray, normalize: bool) -> np.ndarray:
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0) if normalize else x


def om(t: Batch, k: int, indel=1.0, sm="constant", sub_cost=2.0, normalize=False) -> np.ndarray:
    if isinstance(sm, str) and sm != "constant":
        raise ValueError(f"Unknown substitution method: {sm!r}")
    s = cost_table(sm, k, sub_cost)
    return _over(_edit(t, indel, lambda i, j: s[t.a[i], t.b[j]]), t.longest, normalize)


def lcs(t: Batch, k: int, normalize=False) -> np.ndarray:
    """Length of both less twice the longest common subsequence."""
    return _over(_edit(t, 1.0, lambda i, j: np.where(t.a[i] == t.b[j], 0.0, 2.0)), t.la + t.lb, normalize)


def _variant_costs(sm, k, sub_cost) -> np.ndarray:
    return cost_table("constant" if isinstance(sm, str) else sm, k, sub_cost)


def omloc(t: Batch, k: int, indel=1.0, sm="constant", sub_cost=2.0, context_factor=1.0, normalize=False) -> np.ndarray:
    """Substitutions cost more towards the ends of the sequences."""
    s = _variant_costs(sm, k, sub_cost)

    def depth(i, size):
        return np.minimum(i, size - 1 - i) / np.maximum(size - 1, 1)

    def sub(i, j):
        return s[t.a[i], t.b[j]] * (1 + context_factor * (1 - (depth(i, t.la) + depth(j, t.lb)) / 2))

    return _over(_edit(t, indel, sub), t.longest, normalize)


def _spell_lengths(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The length of the spell that each element is in."""
    n, p = x.shape
    inside = np.arange(n)[:, None] < size
    ahead, out = np.zeros((n, p), np.int64), np.ones((n, p), np.int64)
    for i in range(1, n):
        ahead[i] = np.where(x[i] == x[i - 1], ahead[i - 1] + 1, 0)
    behind = np.zeros(p, np.int64)
    for i in range(n - 1, -1, -1):
        same = (x[i] == x[i + 1]) & inside[i + 1] if i + 1 < n else np.zeros(p, bool)
        behind = np.where(same, behind + 1, 0)
        out[i] = ahead[i] + behind + 1
    return out


def omspell(t: Batch, k: int, indel=1.0, sm="constant", sub_cost=2.0, normalize=False) -> np.ndarray:
    """Substitutions cost less inside long spells."""
    s, wa, wb = _variant_costs(sm, k, sub_cost), _spell_lengths(t.a, t.la), _spell_lengths(t.b, t.lb)
    return _over(_edit(t, indel, lambda i, j: s[t.a[i], t.b[j]] / np.sqrt(wa[i] * wb[j])), t.longest, normalize)


def omstran(t: Batch, k: int, indel=1.0, sm="constant", sub_cost=2.0, transition_weights=None, otto=1.0, normalize=False) -> np.ndarray:
    """Substitutions also cost the difference of the transitions that lead to them."""
    s = _variant_costs(sm, k, sub_cost)
    w = np.eye(k) if transition_weights is None else np.asarray(transition_weights, float)

    def sub(i, j):
        cost = s[t.a[i], t.b[j]]
        return cost + otto * np.abs(w[t.a[i - 1], t.a[i]] - w[t.b[j - 1], t.b[j]]) if i and j else cost

    return _over(_edit(t, indel, sub), t.longest, normalize)


def _one_empty(t: Batch, x: np.ndarray, value) -> np.ndarray:
    return np.where((t.la == 0) & (t.lb == 0), 0.0, np.where((t.la == 0) | (t.lb == 0), value, x))


def dtw(t: Batch, k: int, window=0, sm="constant", sub_cost=1.0, normalize=False, times_a=None, times_b=None, max_time_diff=0.0) -> np.ndarray:
    """Time warping; a normalised distance is that over the length of its path (up, left, diagonal in ties)."""
    s, p = cost_table(sm, k, sub_cost), len(t.la)
    timed = max_time_diff > 0 and times_a is not None and times_b is not None
    if timed:
        ta, tb = Batch._padded(times_a, t.la), Batch._padded(times_b, t.lb)
    n, m, pairs = len(t.a), len(t.b), np.arange(p)
    above, steps = _wall(m, p), np.zeros((m + 1, p))
    out, length = above[t.lb, pairs].copy(), np.zeros(p)
    for i in range(1, n + 1):
        row, own = np.full((m + 1, p), np.inf), np.zeros((m + 1, p))
        for j in range(1, m + 1):
            if window > 0 and abs(i - j) > window:
                continue
            best, path = above[j], steps[j]
            for x, y in ((row[j - 1], own[j - 1]), (above[j - 1], steps[j - 1])):
                path = np.where(x < best, y, path)
                best = np.minimum(x, best)
            row[j] = s[t.a[i - 1], t.b[j - 1]] + best
            if timed:
                row[j][np.abs(ta[i - 1] - tb[j - 1]) > max_time_diff] = np.inf
            own[j] = path + 1
        ends = np.flatnonzero(t.la == i)
        out[ends], length[ends] = row[t.lb[ends], ends], own[t.lb[ends], ends]
        above, steps = row, own
    if normalize and not timed:  # a corner outside the window has no path and stays infinite
        out = np.divide(out, length, out=out, where=length > 0)
    return _one_empty(t, out, np.inf)


def softdtw(t: Batch, k: int, gamma=1.0, window=0, sm="constant", sub_cost=1.0, normalize=False) -> np.ndarray:
    if gamma <= 0:
        raise ValueError("gamma must be positive")
    s, p = cost_table(sm, k, sub_cost), len(t.la)

    def cell(i, j, diag, up, left):
        if window > 0 and abs(i - j) > window:
            return np.full(p, np.inf)
        low = np.minimum(np.minimum(diag, up), left)
        base = np.where(np.isfinite(low), low, 0.0)
        total = np.exp(-(diag - base) / gamma) + np.exp(-(up - base) / gamma) + np.exp(-(left - base) / gamma)
        with np.errstate(divide="ignore"):
            return s[t.a[i - 1], t.b[j - 1]] + np.where(np.isfinite(low), base - gamma * np.log(total), np.inf)

    return _one_empty(t, _over(_sweep(t, _wall(len(t.b), p), _wall(len(t.a), p), cell), t.la + t.lb, normalize), np.inf)


def twed(t: Batch, k: int, nu=0.001, lmbda=1.0, sm="constant", sub_cost=1.0, timestamps_a=None, timestamps_b=None, *, lam=None) -> np.ndarray:
    """Time-warp edit distance; time stamps are places from 0 unless given."""
    lmbda = lmbda if lam is None else lam
    if isinstance(sm, str) and sm not in ("constant", "binary"):
        raise ValueError(f"Unknown substitution method: {sm!r}")
    s, p = cost_table(sm, k, sub_cost), len(t.la)
    ta = np.repeat(np.arange(len(t.a), dtype=float)[:, None], p, 1) if timestamps_a is None else Batch._padded(timestamps_a, t.la).astype(float)
    tb = np.repeat(np.arange(len(t.b), dtype=float)[:, None], p, 1) if timestamps_b is None else Batch._padded(timestamps_b, t.lb).astype(float)

    def drops(x, times):
        """The cost to delete each element."""
        out = nu * np.abs(np.diff(times, axis=0, prepend=0.0)) + lmbda
        out[1:] += s[x[1:], x[:-1]]
        return out

    da, db = drops(t.a, ta), drops(t.b, tb)
    # A first element is compared with itself at the border; that is 0 unless a given table says otherwise.
    edge = lambda x, d: np.concatenate([np.zeros((1, p)), np.cumsum(np.concatenate([d[:1] + s[x[:1], x[:1]], d[1:]]), axis=0)])

    def cell(i, j, diag, up, left):
        match = s[t.a[i - 1], t.b[j - 1]] + nu * np.abs(ta[i - 1] - tb[j - 1])
        if i > 1 and j > 1:
            match = match + s[t.a[i - 2], t.b[j - 2]] + nu * np.abs(ta[i - 2] - tb[j - 2])
        return np.minimum(np.minimum(diag + match, up + da[i - 1]), left + db[j - 1])

    return _one_empty(t, _sweep(t, edge(t.b, db), edge(t.a, da), cell), np.inf)


def _embeddings(t: Batch) -> np.ndarray:
    """Matching embeddings of common subsequences, in doubles."""
    zero = lambda n: np.zeros((n + 1, len(t.la)))
    return _sweep(t, zero(len(t.b)), zero(len(t.a)), lambda i, j, diag, up, left: up + left - diag + np.where(t.a[i - 1] == t.b[j - 1], diag + 1, 0.0))


def _self_embeddings(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    own = Batch.__new__(Batch)
    own.a = own.b = codes
    own.la = own.lb = size
    return _embeddings(own)


def nms(t: Batch, k: int, normalize=True) -> np.ndarray:
    both, top = _embeddings(t), np.maximum(_self_embeddings(t.a, t.la), _self_embeddings(t.b, t.lb))
    if not normalize:
        return top - both
    return _one_empty(t, 1 - np.divide(both, top, out=np.zeros_like(both), where=top > 0), 1.0)


def nmsmst(t: Batch, k: int) -> np.ndarray:
    both, scale = _embeddings(t), np.sqrt(_self_embeddings(t.a, t.la) * _self_embeddings(t.b, t.lb))
    return _one_empty(t, np.maximum(0.0, 1 - np.divide(both, scale, out=np.zeros_like(both), where=scale > 0)), 1.0)


def dhd(t: Batch, k: int, position_costs=None, normalize=False) -> np.ndarray:
    if (t.la != t.lb).any():
        raise ValueError("sequences must have equal length")
    c = np.asarray(position_costs, float)
    out = np.zeros(len(t.la))
    for i in range(len(t.a)):
        a, b = t.a[i], t.b[i]
        out += np.where((a != b) & (i < t.la), c[i, a, b], 0.0)
    return _over(out, t.la, normalize)


def levenshtein(t: Batch, k: int) -> np.ndarray:
    """Edit distances with unit costs, 64 cells of a column at once (Myers 1999, Hyyro 2003)."""
    p, words = len(t.la), max(1, -(-len(t.a) // 64))
    one, ones, pairs = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.arange(p)
    equal = np.zeros((words, k, p), np.uint64)  # for each state the places of the first sequence that have it
    for i in range(len(t.a)):
        here = i < t.la
        equal[i // 64, t.a[i, here], pairs[here]] |= np.uint64(1 << i % 64)
    out = t.la.astype(float)
    up, down = np.full((words, p), ones), np.zeros((words, p), np.uint64)
    last, bit = np.maximum(t.la - 1, 0) // 64, (np.maximum(t.la - 1, 0) % 64).astype(np.uint64)
    for j in range(len(t.b)):
        carry_up, carry_down = np.full(p, one), np.zeros(p, np.uint64)
        active = j < t.lb
        for w in range(words):
            pv, mv, eq = up[w], down[w], equal[w, t.b[j], pairs]
            xv = eq | mv
            eq = eq | carry_down
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            change = ((ph >> bit) & one).astype(float) - ((mh >> bit) & one)
            out += np.where(active & (last == w), change, 0.0)
            next_up, next_down = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = (ph << one) | carry_up, (mh << one) | carry_down
            up[w], down[w] = mh | ~(xv | ph), ph & xv
            carry_up, carry_down = next_up, next_down
    return np.where(t.la == 0, t.lb, out).astype(float)


KERNELS = {"om": om, "lcs": lcs, "omloc": omloc, "omspell": omspell, "omstran": omstran, "dtw": dtw, "softdtw": softdtw, "twed": twed, "nms": nms, "nmsmst": nmsmst, "dhd": dhd}
