"""DuckDB SQL for clusterings, trees and permutation tests: the algorithms anew, over a matrix in lists.

Each function gives a string of SQL. ``pairs`` is a query with (id_a, id_b, distance), id_a < id_b. In the
matrix D, D[i][j] is the distance of the sequences at the places i and j, from 1, in the order of the ids.
"""

from __future__ import annotations


def matrix(pairs: str) -> str:
    """CTEs od (the pairs), ids (id, i) and mx (D, n)."""
    return f"""od AS ({pairs}), ids AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM (SELECT id_a AS id FROM od UNION SELECT id_b FROM od)),
mx AS (SELECT list(r ORDER BY i) AS D, count(*) AS n FROM (SELECT a.i AS i, list(coalesce(distance, 0.0) ORDER BY b.i) AS r FROM ids a CROSS JOIN ids b LEFT JOIN od ON id_a = least(a.id, b.id) AND id_b = greatest(a.id, b.id) GROUP BY a.i))"""


def medoids(runs: str) -> str:
    """CTEs rn, bl, sw and md (run, med, cost) for ``runs``, a query with (run, s, k): the places s to search and the number of medoids."""
    near = "list_min(list_transform(med, lambda q: D[i][q]))"
    gain = f"list_sum(list_transform(s, lambda i: greatest({near} - D[i][x], 0.0)))"
    cost = "list_sum(list_transform(s, lambda i: list_min(list_transform({m}, lambda q: D[i][q]))))"
    sums = "list_transform(s, lambda x: list_sum(list_transform(s, lambda i: D[i][x])))"
    return f"""rn AS ({runs}),
bl AS (SELECT run, s, k, [s[list_position(t, list_min(t))]] AS med FROM (SELECT run, s, k, {sums} AS t FROM rn, mx)
  UNION ALL SELECT run, s, k, list_append(med, s[list_position(t, list_max(t))]) FROM
  (SELECT run, s, k, med, list_transform(s, lambda x: CASE WHEN list_contains(med, x) THEN -1.0 ELSE {gain} END) AS t FROM bl, mx WHERE len(med) < k)),
sw AS (SELECT run, s, 0 AS it, med, {cost.format(m='med')} AS cost FROM bl, mx WHERE len(med) = k
  UNION ALL SELECT run, s, it + 1, b[4], b[1] FROM (SELECT run, s, it, cost, min((c, p, x, nm)) AS b FROM
    (SELECT run, s, it, cost, p, x, nm, {cost.format(m='nm')} AS c FROM
      (SELECT run, s, it, cost, p, x, list_transform(med, lambda q, nth: CASE WHEN nth = p THEN x ELSE q END) AS nm FROM
        (SELECT *, unnest(s) AS x FROM (SELECT *, unnest(range(1, len(med) + 1)) AS p FROM sw)) WHERE NOT list_contains(med, x)), mx)
    GROUP BY run, s, it, cost) WHERE b[1] < cost AND it < 100),
md AS (SELECT run, arg_max(med, it) AS med, min(cost) AS cost FROM sw GROUP BY run)"""


def labels() -> str:
    """CTE lb (run, id, i, c, d): the nearest medoid, from 0, and the distance to it."""
    return """lb AS (SELECT run, id, i, list_position(t, list_min(t)) - 1 AS c, list_min(t) AS near, list_contains(med, i) AS is_medoid FROM
  (SELECT run, med, id, i, list_transform(med, lambda q: D[i][q]) AS t FROM md, ids, mx))"""


def pam(pairs: str, k: int) -> str:
    return f"""WITH RECURSIVE {matrix(pairs)}, {medoids(f'SELECT 0 AS run, range(1, n + 1) AS s, {k} AS k FROM mx')}, {labels()}
SELECT id, CAST(c AS INT) AS cluster, is_medoid FROM lb"""


def clara(pairs: str, k: int, samples: int, seed: int) -> str:
    drawn = f"""SELECT run, list(i ORDER BY i) AS s, {k} AS k FROM (SELECT r AS run, i, row_number() OVER (PARTITION BY r ORDER BY md5('{seed}:' || r || ':' || (i - 1))) AS o
  FROM ids CROSS JOIN range({samples}) t(r)) WHERE o <= {40 + 2 * k} GROUP BY run"""
    return f"""WITH RECURSIVE {matrix(pairs)}, {medoids(drawn)}, {labels()}, best AS (SELECT min((cost, run))[2] AS run FROM (SELECT run, sum(near) AS cost FROM lb GROUP BY run))
SELECT id, CAST(c AS INT) AS cluster, is_medoid FROM lb JOIN best USING (run)"""


def pam_range(pairs: str, first: int, last: int) -> str:
    return f"""WITH RECURSIVE {matrix(pairs)}, {medoids(f'SELECT k AS run, range(1, n + 1) AS s, k FROM mx, range({first}, {last + 1}) t(k)')}, {labels()},
sz AS (SELECT run, c, count(*) AS m FROM lb GROUP BY 1, 2),
to_ AS (SELECT a.run, a.i, a.c, b.c AS o, sum(D[a.i][b.i]) AS s, sum(D[a.i][b.i] * D[a.i][b.i]) AS q FROM lb a JOIN lb b USING (run), mx GROUP BY ALL),
ab AS (SELECT to_.run, i, coalesce(sum(s / greatest(m - 1, 1)) FILTER (to_.c = o), 0) AS a, min(s / m) FILTER (to_.c <> o) AS b FROM to_ JOIN sz ON sz.run = to_.run AND sz.c = o GROUP BY 1, 2),
si AS (SELECT run, avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS asw FROM ab GROUP BY run),
ss AS (SELECT to_.run, sum(q) / (2 * any_value(n)) AS st, sum(CASE WHEN to_.c = o THEN q / (2 * m) END) AS sw FROM to_ JOIN sz ON sz.run = to_.run AND sz.c = o, mx GROUP BY to_.run)
SELECT CAST(run AS INT) AS k, round(asw, 6) AS asw, round(1 - sw / st, 6) AS r2, round(cost, 6) AS total_cost FROM si JOIN ss USING (run) JOIN md USING (run)"""


def linkage(pairs: str, method: str, k: int) -> str:
    """Each id with the least id of its cluster; of equal heights the least places merge first."""
    x, y, a, b, c = "D[bi][t]", "D[bj][t]", "sz[bi]", "sz[bj]", "sz[t]"
    new = {
        "single": f"least({x}, {y})",
        "complete": f"greatest({x}, {y})",
        "average": f"({a} * {x} + {b} * {y}) / ({a} + {b})",
        "ward": f"sqrt(greatest(0.0, (({a} + {c}) * ({x} * {x}) + ({b} + {c}) * ({y} * {y}) - {c} * (h * h)) / ({a} + {b} + {c})))",
    }[method]
    inf = "CAST('inf' AS DOUBLE)"
    all_ = "range(1, n + 1)"
    return f"""WITH RECURSIVE {matrix(pairs)},
st AS (SELECT 0 AS step, n, D, list_transform({all_}, lambda i: CAST(1 AS DOUBLE)) AS sz, list_transform({all_}, lambda i: i) AS lab, CAST(0 AS DOUBLE) AS top FROM mx
  UNION ALL SELECT step + 1, n,
    list_transform({all_}, lambda i: list_transform({all_}, lambda j: CASE WHEN i = bj OR j = bj THEN {inf} WHEN i = bi THEN nd[j] WHEN j = bi THEN nd[i] ELSE D[i][j] END)),
    list_transform(sz, lambda v, i: CASE WHEN i = bi THEN sz[bi] + sz[bj] WHEN i = bj THEN 0.0 ELSE v END), list_transform(lab, lambda v: CASE WHEN v = bj THEN bi ELSE v END), greatest(top, h) FROM
  (SELECT *, list_transform({all_}, lambda t: CASE WHEN sz[t] = 0 OR t = bi OR t = bj THEN {inf} ELSE {new} END) AS nd FROM
    (SELECT step, n, D, sz, lab, top, m.h AS h, m.i AS bi, m.j AS bj FROM
      (SELECT *, list_min(flatten(list_transform({all_}, lambda i: list_transform(list_filter(range(i + 1, n + 1), lambda j: sz[i] > 0 AND sz[j] > 0), lambda j: {{'h': D[i][j], 'i': i, 'j': j}})))) AS m FROM st WHERE step < n - 1)))),
cut AS (SELECT max(step) AS step FROM st WHERE top <= (SELECT max(top) FROM st WHERE step = n - {k})),
lb AS (SELECT ids.id, lab[ids.i] AS c FROM st JOIN cut USING (step), ids)
SELECT lb.id, ids.id AS cluster_first FROM lb JOIN ids ON ids.i = c"""


def tree(pairs: str, covariates: str, names: list[str], max_depth: int = 5, min_size: int = 5, min_gain: float = 0.001) -> str:
    """``covariates``: a query with id and the named integers."""
    ss = "(list_sum(list_transform({m}, lambda i: list_sum(list_transform({m}, lambda j: D[i][j] * D[i][j])))) / (2 * len({m})))"

    def best(mem: str, depth: str) -> str:
        side = lambda c, op: f"list_filter({mem}, lambda z: X[{c}][z] {op} v)"
        parts = []
        for c in range(1, len(names) + 1):
            values = f"list_sort(list_distinct(list_transform({mem}, lambda z: X[{c}][z])))"
            fit = f"list_filter(({values})[:-2], lambda v: least(len({side(c, '<=')}), len({side(c, '>')})) >= {min_size})"
            gain = f"1 - ({ss.format(m=side(c, '<='))} + {ss.format(m=side(c, '>'))}) / {ss.format(m=mem)}"
            parts.append(f"list_transform({fit}, lambda v: {{'g': {gain}, 'c': -{c}, 'v': -v}})")
        parts = [p + "::STRUCT(g DOUBLE, c INT, v BIGINT)[]" for p in parts]
        return f"CASE WHEN {depth} < {max_depth} AND len({mem}) >= {2 * min_size} AND {ss.format(m=mem)} > 0 THEN list_max(list_concat({', '.join(parts)})) END"

    x = ", ".join(f"list({c} ORDER BY i)" for c in names)
    named = "CASE b.c " + " ".join(f"WHEN -{k + 1} THEN '{c}'" for k, c in enumerate(names)) + " END"
    return f"""WITH RECURSIVE {matrix(pairs)}, cv AS ({covariates}), xs AS (SELECT [{x}] AS X FROM ids JOIN cv USING (id)),
nd AS (SELECT 0 AS depth, range(1, n + 1) AS mem, {best('range(1, n + 1)', '0')} AS b FROM mx, xs
  UNION ALL SELECT depth, mem, {best('mem', 'depth')} FROM
  (SELECT depth + 1 AS depth, CASE WHEN sd = 0 THEN list_filter(mem, lambda z: X[-b.c][z] <= -b.v) ELSE list_filter(mem, lambda z: X[-b.c][z] > -b.v) END AS mem FROM nd, xs, range(2) t(sd) WHERE b.g > {min_gain}), mx, xs)
SELECT depth, CAST(len(mem) AS INT) AS n, coalesce(b.g, 0) <= {min_gain} AS is_leaf, CASE WHEN b.g > {min_gain} THEN {named} END AS split_variable, CASE WHEN b.g > {min_gain} THEN CAST(-b.v AS VARCHAR) END AS split_value,
  CASE WHEN b.g > {min_gain} THEN round(b.g, 6) ELSE 0.0 END AS pseudo_r2 FROM nd"""


def permutations(pairs: str, factors: dict[str, str], n: int, seed: int) -> str:
    """factor, pseudo_r2, pseudo_f and p_value; ``factors`` are expressions over id. Draws go on from factor to factor."""
    groups = " UNION ALL ".join(f"SELECT '{name}' AS factor, {at} AS place, i, {sql} AS c FROM ids" for at, (name, sql) in enumerate(factors.items()))
    return f"""WITH {matrix(pairs)}, g AS ({groups}), sz AS (SELECT factor, c, count(*) AS m FROM g GROUP BY 1, 2),
od_ AS (SELECT factor, r, i, row_number() OVER (PARTITION BY factor, r ORDER BY md5('{seed}:' || (place * {n} + r) || ':' || (i - 1))) AS q FROM g CROSS JOIN range({n}) t(r)),
lb AS (SELECT o.factor, o.r, o.q AS i, g.c FROM od_ o JOIN g ON g.factor = o.factor AND g.i = o.i UNION ALL SELECT factor, -1, i, c FROM g),
e AS (SELECT a.i AS i, b.i AS j, distance * distance AS q FROM od JOIN ids a ON a.id = id_a JOIN ids b ON b.id = id_b),
wi AS (SELECT a.factor, a.r, sum(q / m) AS sw FROM e JOIN lb a ON a.i = e.i JOIN lb b ON b.i = e.j AND b.factor = a.factor AND b.r = a.r AND b.c = a.c JOIN sz ON sz.factor = a.factor AND sz.c = a.c GROUP BY 1, 2),
f AS (SELECT factor, r, (st - sw) / st AS r2, ((st - sw) / (k - 1)) / (sw / (n - k)) AS f FROM wi JOIN (SELECT factor, count(*) AS k FROM sz GROUP BY 1) USING (factor), (SELECT sum(q) / (SELECT n FROM mx) AS st FROM e), mx)
SELECT o.factor, round(any_value(o.r2), 6) AS pseudo_r2, round(any_value(o.f), 6) AS pseudo_f, round((count(*) FILTER (f.f >= o.f * (1 - 1e-9)) + 1) / ({n} + 1), 6) AS p_value
FROM f JOIN f o ON o.factor = f.factor AND o.r = -1 WHERE f.r >= 0 GROUP BY o.factor"""
