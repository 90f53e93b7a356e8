"""What the registered queries compute, as SQL over the same tables."""

from __future__ import annotations

P = "p AS (SELECT vec_id AS point_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
E = "e AS (SELECT point_id, label, unnest(x) AS v, unnest(range(0, 64)) AS pos FROM p)"
ANCHORS = "a AS (SELECT min(point_id) AS point_id, arg_min(x, point_id) AS x FROM p GROUP BY label)"


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def norm2(x: str) -> str:
    return r(f"list_inner_product({x}, {x})")


def walsh(k: str, j: str) -> str:
    return f"(CASE WHEN bit_count(CAST(({k}) & ({j}) AS INTEGER)) % 2 = 0 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END)"


# The points in the first three Walsh directions.
S = f"{P}, s AS MATERIALIZED (SELECT point_id, label, [" + ", ".join(
    f"list_inner_product(x, list_transform(range(0, 64), lambda j: {walsh(k, 'j')}))" for k in "123") + "] AS x FROM p)"
L1 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))"
LINF = "list_max(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))"
BOX = ("sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: "
       "pow(least(abs(z[1] - z[2]) % 0.25, 0.25 - abs(z[1] - z[2]) % 0.25), 2))))")


def tree(levels: int, rounds: int = 10) -> str:
    """CTEs of the split rule: ``members(point_id, x, node_id, level)``, one recursion step for each round of a level."""
    return f"""WITH RECURSIVE {P},
walk(point_id, x, level, t, node_id, side, c0, c1) AS (
  SELECT point_id, x, 0, -1, CAST(0 AS BIGINT), 0, CAST(NULL AS DOUBLE[]), CAST(NULL AS DOUBLE[]) FROM p
  UNION ALL
  SELECT point_id, x, level, t, node_id, CASE WHEN list_distance(x, c0) <= list_distance(x, c1) THEN 0 ELSE 1 END, c0, c1 FROM (
    WITH w AS (SELECT * FROM walk),
    s AS (SELECT point_id, x, CASE WHEN t = {rounds} THEN level + 1 ELSE level END AS level, CASE WHEN t = {rounds} THEN 0 ELSE t + 1 END AS t,
          CASE WHEN t = {rounds} THEN 2 * node_id + 1 + side ELSE node_id END AS node_id, side, c0, c1 FROM w WHERE NOT (t = {rounds} AND level = {levels - 1})),
    start AS (SELECT *, count(*) OVER n AS size, arg_min(x, point_id) OVER n AS x0 FROM s WHERE t = 0 WINDOW n AS (PARTITION BY node_id)),
    ends AS (SELECT *, arg_min(x, (-round(list_distance(x, x0), 12), point_id)) OVER (PARTITION BY node_id) AS x1 FROM start WHERE size > 1),
    u AS (SELECT node_id, side, list(m ORDER BY pos) AS c FROM (SELECT node_id, side, pos, avg(v) AS m FROM
          (SELECT node_id, side, unnest(x) AS v, unnest(range(0, 64)) AS pos FROM s WHERE t > 0) GROUP BY node_id, side, pos) GROUP BY node_id, side)
    SELECT point_id, x, level, t, node_id, x0 AS c0, x1 AS c1 FROM ends
    UNION ALL
    SELECT s.point_id, s.x, s.level, s.t, s.node_id, coalesce(l.c, s.c0), coalesce(g.c, s.c1) FROM s
    LEFT JOIN u l ON l.node_id = s.node_id AND l.side = 0 LEFT JOIN u g ON g.node_id = s.node_id AND g.side = 1 WHERE s.t > 0)),
members AS MATERIALIZED (SELECT point_id, x, CAST(0 AS BIGINT) AS node_id, 0 AS level FROM p
  UNION ALL SELECT point_id, x, 2 * node_id + 1 + side, level + 1 FROM walk WHERE t = {rounds}),
sums AS (SELECT node_id, level, pos, avg(v) AS m FROM (SELECT node_id, level, unnest(x) AS v, unnest(range(0, 64)) AS pos FROM members) GROUP BY ALL),
centers AS MATERIALIZED (SELECT node_id, level, list(m ORDER BY pos) AS center FROM sums GROUP BY node_id, level),
nodes AS MATERIALIZED (SELECT node_id, level, n, center FROM centers JOIN (SELECT node_id, level, count(*) AS n FROM members GROUP BY ALL) USING (node_id, level))"""


def tree_rows(levels: int) -> str:
    return (f"{tree(levels)} SELECT node_id, CAST(level AS INTEGER) AS level, CASE WHEN node_id > 0 THEN (node_id - 1) // 2 ELSE -1 END AS parent_id, n, "
            f"{norm2('center')} AS center_norm2, level = {levels} AS is_leaf FROM nodes")


LABEL_TREE = f"""
lc AS (SELECT k, list(m ORDER BY pos) AS c FROM (SELECT CAST(label % 7 AS BIGINT) AS k, pos, avg(v) AS m FROM e GROUP BY label % 7, pos) GROUP BY k),
b AS (SELECT k, c, d, list_transform(range(0, 64), lambda j: {walsh('k + d', 'j')}) AS w FROM lc, (SELECT unnest(range(1, 4)) AS d))"""
BY_TREE = """
pick AS (SELECT point_id, x, arg_min(k, (list_distance(x, c), k)) AS n1 FROM p, lc WHERE k IN (1, 2) GROUP BY point_id, x),
pick2 AS (SELECT point_id, x, n1, arg_min(k, (list_distance(x, c), k)) AS n2 FROM pick, lc WHERE k IN (2 * n1 + 1, 2 * n1 + 2) GROUP BY point_id, x, n1),
path AS (SELECT point_id, x, 0 AS level, CAST(0 AS BIGINT) AS node_id FROM pick2 UNION ALL SELECT point_id, x, 1, n1 FROM pick2 UNION ALL SELECT point_id, x, 2, n2 FROM pick2)"""
BY_LEVEL = """
path AS (SELECT point_id, x, level, arg_min(k, (list_distance(x, c), k)) AS node_id
         FROM p, (SELECT *, CASE WHEN k = 0 THEN 0 WHEN k < 3 THEN 1 ELSE 2 END AS level FROM lc) GROUP BY point_id, x, level)"""
Z_ROWS = """SELECT point_id, CAST(level AS INTEGER) AS level, node_id, CAST(d - 1 AS BIGINT) AS pos,
round(list_inner_product(w, x) - list_inner_product(w, c), 6) + 0.0 AS v FROM path JOIN b ON b.k = node_id"""
HATS = """
z AS (SELECT point_id, level, node_id, w, c, list_inner_product(w, x) - list_inner_product(w, c) AS z FROM path JOIN b ON b.k = node_id),
hv AS (SELECT point_id, level, node_id, pos, any_value(cv) + sum(wv * z) AS v FROM
       (SELECT point_id, level, node_id, z, unnest(w) AS wv, unnest(c) AS cv, unnest(range(0, 64)) AS pos FROM z) GROUP BY point_id, level, node_id, pos)"""

# Directions 1, 2, 3, 7 of the Walsh system around the ramp 0.01 * j, as used by the projection queries.
PLANE = f"""
w AS (SELECT d, list_position([1, 2, 3, 7], d) - 1 AS k, list_transform(range(0, 64), lambda j: {walsh('d', 'j')}) AS w FROM (SELECT unnest([1, 2, 3, 7]) AS d)),
ramp AS (SELECT list_transform(range(0, 64), lambda j: j * 0.01::DOUBLE) AS c),
z AS (SELECT point_id, k, w, list_inner_product(w, x) - list_inner_product(w, c) AS z FROM p, w, ramp)"""
HAT = """hat AS (SELECT point_id, pos, pos * 0.01::DOUBLE + sum(wv * z) AS v FROM (SELECT point_id, z, unnest(w) AS wv, unnest(range(0, 64)) AS pos FROM z) GROUP BY point_id, pos)"""

HEAP = """n AS (SELECT point_id AS node_id, CASE WHEN point_id > 0 THEN (point_id - 1) // 2 END AS parent_id, x FROM p),
cosines AS (SELECT 'sibling' AS against, l.parent_id, l.node_id, list_inner_product(l.x, g.x) / sqrt(list_inner_product(l.x, l.x) * list_inner_product(g.x, g.x)) AS cosine
            FROM n l JOIN n g ON g.node_id = l.node_id + 1 WHERE l.node_id % 2 = 1
            UNION ALL SELECT 'parent', l.parent_id, l.node_id, list_inner_product(l.x, g.x) / sqrt(list_inner_product(l.x, l.x) * list_inner_product(g.x, g.x))
            FROM n l JOIN n g ON g.node_id = l.parent_id)"""

REPS = """reps AS (SELECT point_id, level, point_id * 4 + level AS node_id, x[level * 16 + 1 : level * 16 + level + 2] AS z
                   FROM p, (SELECT unnest(range(0, 4)) AS level) WHERE level = 0 OR (point_id + level) % 3 > 0),
filled AS (SELECT g.point_id, g.level, arg_max(reps.node_id, reps.level) AS node_id, arg_max(reps.z, reps.level) AS z
           FROM (SELECT point_id, level FROM p, (SELECT unnest(range(0, 4)) AS level)) g JOIN reps ON reps.point_id = g.point_id AND reps.level <= g.level
           GROUP BY g.point_id, g.level)"""


def knn(source: str, distance: str, k: int, where: str = "true") -> str:
    """Ranked neighbours of every row of ``source`` among its rows."""
    return f"""ranked AS (SELECT q_id, nbr_id, d, row_number() OVER (PARTITION BY q_id ORDER BY d, nbr_id) AS rank FROM
        (SELECT q.point_id AS q_id, n.point_id AS nbr_id, {distance} AS d, q.label AS q_label, n.label AS n_label FROM {source} q, {source} n) WHERE {where}
        QUALIFY rank <= {k})"""


KNN_ROWS = f"SELECT q_id, CAST(rank AS INTEGER) AS rank, nbr_id, {r('d')} AS d FROM ranked"
L2 = "list_distance(q.x, n.x)"


def votes(k: int, train: str, test: str) -> str:
    return f"""ranked AS (SELECT q.point_id, q.label AS label, n.label AS vote, row_number() OVER (PARTITION BY q.point_id ORDER BY list_distance(q.x, n.x), n.point_id) AS rank
        FROM p q, p n WHERE {train} AND {test} QUALIFY rank <= {k}),
        tally AS (SELECT point_id, label, vote, count(*) AS c FROM ranked GROUP BY ALL),
        predicted AS (SELECT point_id, label, arg_min(vote, (-c, vote)) AS prediction FROM tally GROUP BY point_id, label)"""


def pair_counts(source: str, distance: str, radii: list[float]) -> str:
    rows = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS radius, count(*) FILTER (d <= {t}) AS n_pairs FROM d" for t in radii)
    return f"d AS (SELECT {distance} AS d FROM {source} q, {source} n) {rows}"


def sweep(ks: list[int], dims: list[int], levels: list[int], widest: int) -> str:
    """Votes over cuts of the points, one distance for each pair and cut."""
    part = lambda x: f"list_concat({', '.join(f'{x}[{j * widest} + 1 : {j * widest} + d]' if j == 0 else f'CASE WHEN r > {j} THEN {x}[{j * widest} + 1 : {j * widest} + d] ELSE [] END' for j in range(max(levels)))})"
    tally = ", ".join(f"t{k} AS (SELECT d, r, point_id, any_value(label) AS label, vote, count(*) AS c FROM ranked WHERE rank <= {k} GROUP BY d, r, point_id, vote)" for k in ks)
    rows = " UNION ALL ".join(f"""SELECT 'knn_{k}' AS classifier, d, r, count(*) AS n, {r('avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100')} AS accuracy
        FROM (SELECT d, r, point_id, any_value(label) AS label, arg_min(vote, (-c, vote)) AS prediction FROM t{k} GROUP BY d, r, point_id) GROUP BY d, r""" for k in ks)
    return f"""WITH {P}, cuts AS (SELECT unnest({dims})::INTEGER AS d, rs.r FROM (SELECT unnest({levels})::INTEGER AS r) rs),
        cut AS MATERIALIZED (SELECT d, r, point_id, label, {part('x')} AS x FROM p, cuts),
        ranked AS (SELECT q.d, q.r, q.point_id, q.label AS label, n.label AS vote, row_number() OVER (PARTITION BY q.d, q.r, q.point_id ORDER BY list_distance(q.x, n.x), n.point_id) AS rank
        FROM cut q JOIN cut n ON n.d = q.d AND n.r = q.r WHERE n.point_id % 100 < 70 AND q.point_id % 100 >= 70 QUALIFY rank <= {max(ks)}), {tally} {rows}"""


def layer(name: str, source: str, width: int, out: int) -> str:
    """One sigmoid layer with the stated weights: rows ``(point_id, j, v)`` from rows ``(point_id, i, v)``."""
    return (f"{name} AS (SELECT point_id, j, 1 / (1 + exp(-(sum(v * (((7 * i + 3 * j) % 11) - 5) / 10.0::DOUBLE) + (j % 3) / 10.0::DOUBLE))) AS v "
            f"FROM (SELECT point_id, {'pos' if source == 'e' else 'j'} AS i, v FROM {source}), (SELECT unnest(range(0, {out})) AS j) t(j) GROUP BY point_id, j)")


FRAME = f"""f AS (SELECT vec_id AS frame_no, list_concat(CAST(embedding AS DOUBLE[]), list_transform(range(0, 11), lambda j: 0.0::DOUBLE)) AS x FROM embeddings),
flat AS (SELECT frame_no, unnest(x) AS v, unnest(range(0, 75)) AS pos FROM f),
atoms AS (SELECT frame_no, a AS atom, x[a * 3 + 1] AS x, x[a * 3 + 2] AS y, x[a * 3 + 3] AS z FROM f, (SELECT unnest(range(0, 25)) AS a))"""
PRODUCT = f"""WITH {P}, {E}, m AS (SELECT pos, label AS c, avg(v) AS m FROM e GROUP BY pos, label)
SELECT point_id AS i, CAST(c AS BIGINT) AS pos, {r('sum(v * m)')} AS v FROM e JOIN m USING (pos) GROUP BY point_id, c"""
SVD_FACTS = f"""WITH {P}, {E}, g AS (SELECT a.pos AS i, b.pos AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (point_id) GROUP BY ALL)
SELECT (SELECT count(*) FROM p) AS n, 64.0::DOUBLE AS left_norm2, {r('sum(v) FILTER (i = j)', 4)} AS s2, {r('sum(v * v)', 4)} AS s4 FROM g"""

# One step of each linear algorithm for class c (from 1): new weights from w, row x and its sign s (1 for the row's class, else -1).
MARGIN = "(s * list_inner_product(w, x))"
MOVED = "list_transform(list_zip(w, x), lambda z: z[1] + {by} * s * z[2])"
TYPICAL = "sqrt(1.0::DOUBLE / sqrt(0.0001::DOUBLE))"
RATE = f"(1.0::DOUBLE / (0.0001::DOUBLE * (1.0::DOUBLE / (0.0001::DOUBLE * {TYPICAL}) + t)))"
SHRUNK = f"list_transform(list_zip(w, x), lambda z, k: z[1] * (CASE WHEN k <= 64 THEN 1.0::DOUBLE - {RATE} * 0.0001::DOUBLE ELSE 1.0::DOUBLE END) + (CASE WHEN {MARGIN} < 1 THEN {RATE} * s ELSE 0 END) * z[2])"
LINEAR = {
    "sgd": SHRUNK, "asgd": SHRUNK,
    "perceptron": f"CASE WHEN {MARGIN} <= 0 THEN {MOVED.format(by='1')} ELSE w END",
    "passive_aggressive_1": MOVED.format(by=f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - {MARGIN}) / list_inner_product(x, x))"),
    "passive_aggressive_2": MOVED.format(by=f"(greatest(0.0::DOUBLE, 1 - {MARGIN}) / (list_inner_product(x, x) + 0.5))"),
}


def linear_in_order() -> str:
    """All rows in turn, one recursion step each; a class is a row of the recursion, with its weights and their sum over the steps."""
    zeros = "list_transform(range(0, 65), lambda j: 0.0::DOUBLE)"
    steps = [f"""{name} AS (SELECT 0 AS n, c, {zeros} AS w, {zeros} AS total FROM classes UNION ALL
        SELECT n + 1, c, new, list_transform(list_zip(total, new), lambda z: z[1] + z[2]) FROM (
            SELECT n, c, total, {update} AS new FROM (SELECT r.n, r.c, r.w, r.total, o.x, o.t, CASE WHEN o.label = r.c THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s
            FROM {name} r JOIN o ON o.t = r.n + 1)))""" for name, update in LINEAR.items()]
    ends = [f"""SELECT '{name}' AS algorithm, c, {'list_transform(total, lambda v: v / n)' if name == 'asgd' else 'w'} AS w FROM {name} WHERE n = (SELECT max(t) FROM o)""" for name in LINEAR]
    return f"""WITH RECURSIVE {P}, o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY point_id) AS t, list_append(x, 1.0::DOUBLE) AS x, label FROM p),
        classes AS (SELECT DISTINCT label AS c FROM p), {", ".join(steps)}, ends AS ({" UNION ALL ".join(ends)})
        SELECT algorithm, CAST(c AS BIGINT) AS label, pos, {r('v')} AS v FROM (SELECT algorithm, c, unnest(w) AS v, unnest(range(0, 65)) AS pos FROM ends)"""


def autoencoder_epochs(epochs: int, rate: float) -> str:
    """Full gradients of a 64-2-64 sigmoid autoencoder from the stated weights; one group of CTEs for each epoch."""
    stated = "(((7 * i + 3 * j) % 11) - 5) / 10.0::DOUBLE"
    out = [f"""{P}, {E}, size AS (SELECT count(*) AS n FROM p),
        u0 AS (SELECT i, j, {stated} AS v FROM (SELECT unnest(range(0, 64)) AS i), (SELECT unnest(range(0, 2)) AS j)),
        w0 AS (SELECT i, j, {stated} AS v FROM (SELECT unnest(range(0, 2)) AS i), (SELECT unnest(range(0, 64)) AS j)),
        a0 AS (SELECT j, (j % 3) / 10.0::DOUBLE AS v FROM (SELECT unnest(range(0, 2)) AS j)), b0 AS (SELECT j, (j % 3) / 10.0::DOUBLE AS v FROM (SELECT unnest(range(0, 64)) AS j))"""]
    for k in range(epochs):
        out.append(f"""h{k} AS MATERIALIZED (SELECT point_id, u.j, 1 / (1 + exp(-(sum(e.v * u.v) + any_value(a.v)))) AS v FROM e JOIN u{k} u ON u.i = e.pos JOIN a{k} a ON a.j = u.j GROUP BY point_id, u.j),
        o{k} AS MATERIALIZED (SELECT point_id, w.j, 1 / (1 + exp(-(sum(h.v * w.v) + any_value(b.v)))) AS v FROM h{k} h JOIN w{k} w ON w.i = h.j JOIN b{k} b ON b.j = w.j GROUP BY point_id, w.j),
        d{k} AS MATERIALIZED (SELECT o.point_id, o.j, 2 * (o.v - e.v) / (size.n * 64) * o.v * (1 - o.v) AS v, o.v - e.v AS gap FROM o{k} o JOIN e ON e.point_id = o.point_id AND e.pos = o.j, size),
        g{k} AS MATERIALIZED (SELECT h.point_id, h.j, sum(d.v * w.v) * any_value(h.v) * (1 - any_value(h.v)) AS v FROM h{k} h JOIN d{k} d ON d.point_id = h.point_id JOIN w{k} w ON w.i = h.j AND w.j = d.j GROUP BY h.point_id, h.j),
        w{k + 1} AS MATERIALIZED (SELECT w.i, w.j, any_value(w.v) - {rate} * sum(h.v * d.v) AS v FROM w{k} w JOIN h{k} h ON h.j = w.i JOIN d{k} d ON d.point_id = h.point_id AND d.j = w.j GROUP BY w.i, w.j),
        b{k + 1} AS MATERIALIZED (SELECT b.j, any_value(b.v) - {rate} * sum(d.v) AS v FROM b{k} b JOIN d{k} d ON d.j = b.j GROUP BY b.j),
        u{k + 1} AS MATERIALIZED (SELECT u.i, u.j, any_value(u.v) - {rate} * sum(e.v * g.v) AS v FROM u{k} u JOIN e ON e.pos = u.i JOIN g{k} g ON g.point_id = e.point_id AND g.j = u.j GROUP BY u.i, u.j),
        a{k + 1} AS MATERIALIZED (SELECT a.j, any_value(a.v) - {rate} * sum(g.v) AS v FROM a{k} a JOIN g{k} g ON g.j = a.j GROUP BY a.j)""")
    costs = " UNION ALL ".join(f"SELECT {k + 1}::INTEGER AS epoch, {r('avg(gap * gap)', 8)} AS cost FROM d{k}" for k in range(epochs))
    return "WITH " + ", ".join(out) + " " + costs


ORACLES: dict[str, str] = {
    "read_frames_range": "SELECT event_id, value FROM events WHERE event_id < (SELECT count(*) * 8 // 10 FROM events)",
    "read_frames_midpoints": "SELECT event_id, event_type FROM events WHERE event_id % 100 = 49",
    "flatten_frames": f"WITH {FRAME} SELECT frame_no, pos, {r('v')} AS v FROM flat",
    "explode_atoms": f"WITH {FRAME} SELECT frame_no, atom, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z FROM atoms",
    "select_atoms": f"""WITH {FRAME}, t AS (SELECT n_nationkey AS atom, row_number() OVER (ORDER BY n_nationkey) - 1 AS slot FROM nation WHERE n_regionkey < 2)
        SELECT frame_no, CAST(slot * 3 + pos % 3 AS BIGINT) AS pos, {r('v')} AS v FROM flat JOIN t ON flat.pos // 3 = t.atom""",
    "read_labels": "SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(quality AS DOUBLE) AS label FROM labels",
    "save_and_load_model": f"{tree(2)} SELECT node_id, n, {norm2('center')} AS center_norm2, level = 2 AS is_leaf FROM nodes",
    "export_model_text": f"{tree(1)} SELECT node_id, unnest(range(0, 64)) AS pos, {r('unnest(center)')} AS v FROM nodes",
    "with_row_index": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders",
    "union_trajectories": "SELECT vec_id AS point_id, label, CAST(label % 3 AS INTEGER) AS traj_id FROM embeddings",
    "downsample": "SELECT event_id, value FROM events WHERE event_id % 10 = 0",
    "matrix_add": f"WITH {P}, {E} SELECT a.point_id AS i, a.pos, {r('a.v + b.v')} AS v FROM e a JOIN e b ON b.point_id = a.point_id AND b.pos = 63 - a.pos",
    "matrix_scale": f"WITH {P}, {E} SELECT point_id AS i, pos, {r('v * -2.5')} AS v FROM e",
    "matrix_transpose": f"WITH {P}, {E} SELECT pos AS i, point_id // 128 AS segment, point_id AS j, {r('v')} AS v FROM e",
    "transpose_entries": f"WITH {P}, {E} SELECT pos AS i, point_id AS j, {r('v')} AS v FROM e",
    "matrix_multiply": PRODUCT,
    "matrix_multiply_blocks": PRODUCT,
    "multiply_entries": f"WITH {P}, {E} SELECT a.pos AS i, b.pos AS j, {r('sum(a.v * b.v)')} AS v FROM e a JOIN e b USING (point_id) GROUP BY a.pos, b.pos",
    "matrix_vector": f"WITH {P}, {E} SELECT point_id AS i, {r('sum(v * pos * 0.01)')} AS y FROM e GROUP BY point_id",
    "identity": "SELECT i, i AS j, 1.0::DOUBLE AS v FROM (SELECT unnest(range(0, (SELECT count(*) FROM events))) AS i)",
    "to_blocks": f"""WITH {P}, {E} SELECT point_id // 128 AS bi, pos // 24 AS bj, CAST(count(DISTINCT point_id) AS INTEGER) AS height,
        CAST(count(DISTINCT pos) AS INTEGER) AS width, {r('sum(v)')} AS total FROM e GROUP BY ALL""",
    "row_means": f"WITH {P}, {E} SELECT point_id AS i, {r('avg(v)')} AS mean FROM e GROUP BY point_id",
    "column_means": f"WITH {P}, {E} SELECT pos, {r('avg(v)')} AS v FROM e GROUP BY pos",
    "subtract_vector": f"WITH {P}, {E} SELECT point_id AS i, pos, {r('v - pos * 0.01::DOUBLE')} AS v FROM e",
    "center_columns": f"WITH {P}, {E} SELECT point_id AS i, pos, {r('v - avg(v) OVER (PARTITION BY pos)')} AS v FROM e",
    "matrix_size_kb": "SELECT label, round(count(*) * 64 * 8 / 1024.0, 6)::DOUBLE + 0.0 AS kb FROM embeddings GROUP BY label",
    "covariance": f"""WITH {P}, {E}, c AS (SELECT point_id, pos, v - avg(v) OVER (PARTITION BY pos) AS v FROM e)
        SELECT a.pos AS i, b.pos AS j, {r('avg(a.v * b.v)', 8)} AS v FROM c a JOIN c b USING (point_id) GROUP BY a.pos, b.pos""",
    "pca_spectrum": f"""WITH {P}, {E}, c AS (SELECT point_id, pos, v - avg(v) OVER (PARTITION BY pos) AS v FROM e),
        g AS (SELECT a.pos AS i, b.pos AS j, avg(a.v * b.v) AS v FROM c a JOIN c b USING (point_id) GROUP BY a.pos, b.pos)
        SELECT (SELECT count(*) FROM p) AS n, {r('sum(v) FILTER (i = j)')} AS trace, {r('sum(v * v)')} AS trace2,
        (SELECT {r('sum(v * v)', 4)} FROM e) AS energy FROM g""",
    "variance_explained_plane": f"""WITH {S}, c AS (SELECT count(*) AS n, var_pop(x[1]) AS a, var_pop(x[2]) AS b, covar_pop(x[1], x[2]) AS ab FROM s)
        SELECT n, {r('(a + b + sqrt((a - b) * (a - b) + 4 * ab * ab)) / 2 / (a + b)', 8)} AS share FROM c""",
    "ml_pca_energy": f"WITH {P} SELECT point_id, {norm2('x')} AS norm2 FROM p",
    "truncated_svd": SVD_FACTS,
    "incremental_svd": SVD_FACTS,
    "frequent_directions": f"""WITH {P}, w AS (SELECT d, list_transform(range(0, 64), lambda j: {walsh('d', 'j')}) AS w FROM (SELECT unnest(range(0, 64)) AS d))
        SELECT d AS direction, {r('sum(pow(list_inner_product(x, w), 2))', 5)} AS energy, true AS within, true AS bounded FROM p, w GROUP BY d""",
    "project": f"WITH {P}, {PLANE} SELECT point_id, CAST(k AS BIGINT) AS pos, {r('z')} AS v FROM z",
    "affine_reconstruct": f"WITH {P}, {PLANE}, {HAT} SELECT point_id, pos, {r('v')} AS v FROM hat",
    "subspace_cosines": f"WITH {P}, {HEAP} SELECT against, CAST(parent_id AS BIGINT) AS parent_id, node_id, {r('cosine')} AS cosine FROM cosines",
    "split_cells": f"{tree(1)} SELECT node_id, n, {norm2('center')} AS center_norm2 FROM nodes WHERE level = 1",
    "fit_cells": f"""{tree(1)} SELECT node_id, any_value(n) AS n, {norm2('any_value(center)')} AS center_norm2, {r('sum(pow(list_distance(x, center), 2))')} AS scatter
        FROM members JOIN nodes USING (node_id, level) GROUP BY node_id""",
    "fit_tree": tree_rows(3),
    "fit_tree_distributed": tree_rows(2),
    "next_resolution": f"{tree(2)} SELECT node_id, n, {norm2('center')} AS center_norm2 FROM nodes WHERE level = 2",
    "prune_cells": f"""WITH {P}, {HEAP}, bad AS (SELECT DISTINCT parent_id FROM cosines WHERE against = 'sibling' AND cosine >= 0.2),
        up AS (SELECT node_id, unnest(list_transform(range(1, 40), lambda i: ((node_id + 1) >> i) - 1)) AS a FROM n),
        kept AS (SELECT node_id, parent_id FROM n WHERE node_id NOT IN (SELECT node_id FROM up WHERE a >= 0 AND a IN (SELECT parent_id FROM bad)))
        SELECT node_id, node_id NOT IN (SELECT parent_id FROM kept WHERE parent_id IS NOT NULL) AS is_leaf FROM kept""",
    "representations": f"""{tree(2)} SELECT point_id, CAST(level AS INTEGER) AS level, node_id, {r('pow(list_distance(x, center), 2)')} AS z_norm2
        FROM members JOIN nodes USING (node_id, level)""",
    "project_points": f"WITH {P}, {E}, {LABEL_TREE}, {BY_TREE} {Z_ROWS}",
    "project_points_by_level": f"WITH {P}, {E}, {LABEL_TREE}, {BY_LEVEL} {Z_ROWS}",
    "multiscale_features": f"""WITH {P}, {REPS} SELECT point_id, level * 4 + slot AS pos, {r('coalesce(z[slot + 1], 0.0)')} AS v FROM filled, (SELECT unnest(range(0, 4)) AS slot)""",
    "fill_levels": f"WITH {P}, {REPS} SELECT point_id, CAST(level AS INTEGER) AS level, node_id FROM filled",
    "reconstructions": f"""WITH {P}, {E}, {LABEL_TREE}, {BY_TREE}, {HATS}
        SELECT point_id, CAST(level AS INTEGER) AS level, node_id, {r('sum(v * v)')} AS x_hat_norm2 FROM hv GROUP BY point_id, level, node_id""",
    "wavelets": f"""WITH {P}, {E}, {LABEL_TREE}, {BY_TREE}, {HATS}
        SELECT a.point_id, CAST(a.level AS INTEGER) AS level, {r('sum(pow(b.v - a.v, 2))')} AS q_norm2
        FROM hv a JOIN hv b ON b.point_id = a.point_id AND b.pos = a.pos AND b.level = a.level + 1 GROUP BY a.point_id, a.level""",
    "wavelet_bases": f"""WITH k AS (SELECT CAST(label % 7 AS BIGINT) AS k FROM embeddings WHERE label % 7 > 0 GROUP BY label % 7)
        SELECT k AS node_id, d AS direction, CASE WHEN k + 1 + d BETWEEN (k - 1) // 2 + 1 AND (k - 1) // 2 + 3 THEN 0.0 ELSE 1.0 END::DOUBLE AS psi_norm2
        FROM k, (SELECT unnest(range(0, 3)) AS d)""",
    "check_partition": f"""{tree(3)} SELECT CAST(level AS BIGINT) AS level, count(*) AS n_points, count(DISTINCT node_id) AS n_cells, CAST(0 AS BIGINT) AS violations
        FROM members GROUP BY level""",
    "level_sizes": f"""SELECT level, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_points, max(n) AS max_points, {r('max(n) * 0.5')}::DOUBLE AS max_kb
        FROM (SELECT l_linenumber AS level, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY level""",
    "metrics_named": f"""WITH {P}, {ANCHORS}, pairs AS (SELECT p.point_id AS i, a.point_id AS j, p.x AS u, a.x AS w FROM p, a)
        SELECT 'euclidean' AS metric, i, j, {r('list_distance(u, w)')} AS d FROM pairs
        UNION ALL SELECT 'cityblock', i, j, {r(L1.format(a='u', b='w'))} FROM pairs UNION ALL SELECT 'chebyshev', i, j, {r(LINF.format(a='u', b='w'))} FROM pairs""",
    "metric_expressions": f"""WITH {P}, m AS (SELECT point_id, x AS u, list_reverse(x) AS w FROM p)
        SELECT point_id, {r('list_distance(u, w)')} AS d0, {r(L1.format(a='u', b='w'))} AS d1, {r(LINF.format(a='u', b='w'))} AS d2, {r(BOX.format(a='u', b='w'))} AS d3 FROM m""",
    "levenshtein_pair_counts": "WITH w AS (SELECT p_name AS x, count(*) AS w FROM part GROUP BY p_name), d AS (SELECT levenshtein(a.x, b.x) AS d, a.w * b.w AS w FROM w a, w b) "
        + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS radius, CAST(coalesce(sum(w) FILTER (d <= {t}), 0) AS BIGINT) AS n_pairs FROM d" for t in (0, 1, 3, 5)),
    "levenshtein_close_pairs": """WITH n AS (SELECT p_name AS x, min(p_partkey) AS id FROM part GROUP BY p_name)
        SELECT 'pair' AS part, a.id AS i, b.id AS j, levenshtein(a.x, b.x)::DOUBLE AS d FROM n a JOIN n b ON a.id < b.id WHERE levenshtein(a.x, b.x) <= 4
        UNION ALL SELECT 'member', p.p_partkey, n.id, 0.0::DOUBLE FROM part p JOIN n ON n.x = p.p_name""",
    "periodic_pair_counts": f"WITH {S}, " + pair_counts("s", BOX.format(a="q.x", b="n.x"), [0.02, 0.05, 0.1]),
    "custom_metric_knn": f"WITH {S}, " + knn("s", "abs(q.x[1] - n.x[1]) + 2 * abs(q.x[2] - n.x[2]) + 3 * abs(q.x[3] - n.x[3])", 5, "q_id <> nbr_id") + " " + KNN_ROWS,
    "knn_join": f"WITH {P}, " + knn("p", L2, 7) + " " + KNN_ROWS,
    "knn_join_bounded": f"WITH {P}, " + knn("p", L2, 7, "d <= 1.2") + " " + KNN_ROWS,
    "knn_join_pruned": f"WITH {S}, " + knn("s", L2, 7) + " " + KNN_ROWS,
    "approximate_knn_contract": "SELECT count(*) AS n_queries, CAST(0 AS BIGINT) AS n_short, CAST(0 AS BIGINT) AS n_beyond FROM embeddings",
    "neighbours_within": f"WITH {P}, " + knn("p", L2, 1_000_000_000, "d <= 1.2") + f" SELECT q_id, rank - 1 AS pos, nbr_id, {r('d')} AS d FROM ranked",
    "pad_neighbours": f"WITH {P}, " + knn("p", L2, 5, "d <= 1.15") + """
        SELECT s.q_id, s.rank, coalesce(ranked.nbr_id, (SELECT count(*) FROM p)) AS nbr_id, coalesce(round(d, 6) + 0.0, 'infinity'::DOUBLE) AS d
        FROM (SELECT point_id AS q_id, CAST(unnest(range(1, 6)) AS INTEGER) AS rank FROM p) s LEFT JOIN ranked ON ranked.q_id = s.q_id AND ranked.rank = s.rank""",
    "ball_search": f"""WITH {P}, {ANCHORS}, d AS (SELECT a.point_id AS q_id, p.point_id AS nbr_id, list_distance(a.x, p.x) AS d FROM a, p)
        SELECT q_id, count(*) AS n, arg_max(nbr_id, (d, nbr_id)) AS last_id, {r('sum(d)')} AS total FROM d WHERE d <= 1.25 GROUP BY q_id""",
    "range_join": f"WITH {P}, m AS (SELECT point_id, list_reverse(x) AS x FROM p) SELECT q.point_id AS i, n.point_id AS j, {r(L2)} AS d FROM p q, m n WHERE {L2} <= 1.2",
    "range_join_pruned": f"WITH {S}, m AS (SELECT point_id, list_reverse(x) AS x FROM s) SELECT q.point_id AS i, n.point_id AS j, {r(L2)} AS d FROM s q, m n WHERE {L2} <= 0.05",
    "close_pairs": f"WITH {P} SELECT q.point_id AS i, n.point_id AS j, {r(L2)} AS d FROM p q, p n WHERE q.point_id < n.point_id AND {L2} <= 1.2",
    "close_pairs_pruned": f"WITH {S} SELECT q.point_id AS i, n.point_id AS j, {r(L2)} AS d FROM s q, s n WHERE q.point_id < n.point_id AND {L2} <= 0.05",
    "count_pairs": f"WITH {P}, " + pair_counts("p", L2, [1.1, 1.2, 1.3]),
    "count_pairs_pruned": f"WITH {S}, " + pair_counts("s", L2, [0.05, 0.2, 0.5, 2.0]),
    "sparse_distances": f"WITH {P} SELECT q.point_id AS i, n.point_id AS j, {r(L2)} AS d FROM p q, p n WHERE {L2} <= 1.15",
    "metric_partitions": f"""WITH {P}, {ANCHORS}, m AS (SELECT p.point_id, arg_min(a.point_id, (list_distance(p.x, a.x), a.point_id)) AS pivot_id, min(list_distance(p.x, a.x)) AS d FROM p, a GROUP BY p.point_id)
        SELECT pivot_id, count(*) AS n, {r('max(d)')} AS radius FROM m GROUP BY pivot_id""",
    "metric_partition_members": f"""WITH {P}, {ANCHORS} SELECT p.point_id, arg_min(a.point_id, (list_distance(p.x, a.x), a.point_id)) AS pivot_id, {r('min(list_distance(p.x, a.x))')} AS d
        FROM p, a GROUP BY p.point_id""",
    "check_metric_partitions": f"""WITH {P}, {ANCHORS}, m AS (SELECT p.point_id, arg_min(a.point_id, (list_distance(p.x, a.x), a.point_id)) AS pivot_id, min(list_distance(p.x, a.x)) AS d FROM p, a GROUP BY p.point_id),
        s AS (SELECT pivot_id, max(d) AS radius FROM m GROUP BY pivot_id)
        SELECT 'radius_covers' AS rule, count(*) FILTER (d > radius) AS violations FROM m JOIN s USING (pivot_id)
        UNION ALL SELECT 'exactly_one_cell', (SELECT count(*) FROM p) - count(DISTINCT point_id) FROM m""",
    "distance_matrix": f"WITH {P}, {ANCHORS} SELECT p.point_id AS i, a.point_id AS j, {r('list_distance(p.x, a.x)')} AS d FROM p, a",
    "expand_window_labels": """SELECT e.event_id AS frame_no, e.event_id // 100 AS window_id, m.event_type AS label
        FROM events e JOIN events m ON m.event_id = (e.event_id // 100) * 100 + 50""",
    "slice_per_trajectory": "SELECT event_id AS frame_no, value FROM events WHERE event_id % 1000 < 700",
    "train_test_split": "SELECT event_id, CASE WHEN event_id % 100 < 70 THEN 'train' ELSE 'test' END AS part FROM events",
    "superpose": f"""WITH {FRAME}, ref AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM atoms WHERE frame_no = (SELECT min(frame_no) FROM atoms))
        SELECT frame_no, {r('any_value(mx)')} AS mean_x, {r('any_value(my)')} AS mean_y, {r('any_value(mz)')} AS mean_z,
        {r('var_pop(x) + var_pop(y) + var_pop(z)')} AS spread FROM atoms, ref GROUP BY frame_no""",
    "superpose_turned": f"""WITH {FRAME} SELECT f.frame_no, a.atom, {r('a.x')} AS x, {r('a.y')} AS y, {r('a.z')} AS z
        FROM f, atoms a WHERE a.frame_no = (SELECT min(frame_no) FROM f)""",
    "pairwise_atom_distances": f"""WITH {FRAME}, c AS (SELECT * FROM atoms WHERE atom IN (0, 5, 10, 15, 20))
        SELECT a.frame_no, row_number() OVER (PARTITION BY a.frame_no ORDER BY a.atom, b.atom) - 1 AS pos,
        {r('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))')} AS v FROM c a JOIN c b ON a.frame_no = b.frame_no AND a.atom < b.atom""",
    "knn_classify": f"WITH {P}, {votes(7, 'q.point_id <> n.point_id', 'true')} SELECT point_id, prediction FROM predicted",
    "accuracy": f"WITH {P}, {votes(7, 'q.point_id <> n.point_id', 'true')} SELECT count(*) AS n, {r('avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100')} AS accuracy FROM predicted",
    "classify_split": f"""WITH {P}, {votes(7, 'n.point_id % 100 < 70', 'q.point_id % 100 >= 70')}
        SELECT 'knn_7' AS classifier, count(*) AS n, {r('avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100')} AS accuracy FROM predicted""",
    "classify_held_out": f"""WITH {P}, {votes(3, 'n.point_id % 100 < 70', 'q.point_id % 100 >= 70')}
        SELECT 'knn_3' AS classifier, count(*) AS n, {r('avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100')} AS accuracy FROM predicted""",
    "logistic_contract": "SELECT DISTINCT CAST(label AS BIGINT) AS label, (SELECT count(*) FROM embeddings) AS n, true AS level FROM embeddings",
    "kernel_machine_contract": "SELECT DISTINCT CAST(label AS BIGINT) AS label, CAST(1 AS BIGINT) AS has_both, true AS balanced, CAST(0 AS BIGINT) AS violations FROM embeddings",
    "linear_in_order": linear_in_order(),
    "sweep_knn": sweep([3, 7], [4, 16], [1, 2, 4], 16),
    "fit_autoencoder_gradient": autoencoder_epochs(3, 2.0),
    "encode": f"WITH {P}, {E}, {layer('h1', 'e', 64, 3)}, {layer('h2', 'h1', 3, 2)} SELECT point_id, j AS pos, {r('v')} AS v FROM h2",
    "reconstruct": f"WITH {P}, {E}, {layer('h1', 'e', 64, 3)}, {layer('h2', 'h1', 3, 2)}, {layer('h3', 'h2', 2, 3)}, {layer('h4', 'h3', 3, 64)} SELECT point_id, j AS pos, {r('v')} AS v FROM h4",
    "reconstruction_error": f"""WITH {P}, {E}, {PLANE}, {HAT} SELECT count(DISTINCT e.point_id) AS n, {r('sum(pow(e.v - hat.v, 2))', 4)} AS total,
        {r('sum(pow(e.v - hat.v, 2)) / count(*)')} AS average FROM e JOIN hat USING (point_id, pos)""",
}
