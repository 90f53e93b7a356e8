import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyscale.functions import metrics
from manyscale.operators import neighbours as nbr
from manyscale.plans import blocks, cells, sketches

CUBE = np.array(list(itertools.product([0.0, 1.0], repeat=3)))
PLAIN = {"euclidean": lambda d: np.sqrt((d * d).sum(-1)), "cityblock": lambda d: np.abs(d).sum(-1),
         "chebyshev": lambda d: np.abs(d).max(-1)}


def brute(a, b, metric="euclidean"):
    return PLAIN[metric](a[:, None, :] - b[None, :, :])


def nearest_rows(d, k, skip_self=False):
    out = {}
    for i, row in enumerate(d):
        order = [j for j in sorted(range(len(row)), key=lambda j: (row[j], j)) if not (skip_self and i == j)]
        out[i] = order[:k]
    return out


def as_lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.q_id, r["rank"])):
        out.setdefault(r.q_id, []).append(r.nbr_id)
    return out


def gauss(n, dims, seed, shift=0.0):
    return np.random.default_rng(seed).normal(size=(n, dims)) + shift


def test_cube_corner(spark, table):
    found = nbr.knn_join(table([[0, 0, 0.1]]), table(CUBE), 2).orderBy("rank").collect()
    assert [r.nbr_id for r in found] == [0, 1]
    assert np.allclose([r.d for r in found], [0.1, 0.9])


@pytest.mark.parametrize("cells,size,metric", [
    (None, None, "euclidean"), (None, 16, "euclidean"), (7, 16, "euclidean"), (20, 1024, "cityblock"), (7, 16, "chebyshev")])
def test_knn_equals_brute_force(table, cells, size, metric):
    x, q = gauss(100, 4, 1), gauss(30, 4, 2)
    found = nbr.knn_join(table(q), table(x), 10, metric=metric, cells=cells, rows_per_block=size)
    assert as_lists(found) == nearest_rows(brute(q, x, metric), 10)


def test_knn_far_query_and_bound(table):
    x, q = gauss(100, 4, 3), gauss(5, 4, 4, shift=10.0)
    assert as_lists(nbr.knn_join(table(q), table(x), 10, cells=6)) == nearest_rows(brute(q, x), 10)
    near = gauss(20, 4, 5)
    found = nbr.knn_join(table(near), table(x), 10, distance_upper_bound=1.0, cells=6)
    d = brute(near, x)
    expected = {i: [j for j in js if d[i, j] <= 1.0] for i, js in nearest_rows(d, 10).items()}
    assert as_lists(found) == {i: js for i, js in expected.items() if js}


@pytest.mark.parametrize("eps", [0.1, 2.0])
def test_approximate_knn_keeps_its_contract(table, eps):
    x, q = gauss(300, 3, 6), gauss(40, 3, 7)
    found = nbr.knn_join(table(q), table(x), 5, eps=eps, cells=30, rows_per_block=64).collect()
    true = np.sort(brute(q, x), axis=1)[:, 4]
    worst, count = np.zeros(40), np.zeros(40)
    for r in found:
        worst[r.q_id] = max(worst[r.q_id], r.d)
        count[r.q_id] += 1
    assert (count == 5).all() and (worst <= true * (1 + eps) + 1e-12).all()


@pytest.mark.parametrize("metric,eps", [("euclidean", 0.0), ("cityblock", 0.0), ("euclidean", 0.5)])
def test_second_visit_after_the_own_cell(table, monkeypatch, metric, eps):
    monkeypatch.setattr(nbr, "REFINE_ROWS", 0)
    x, q = gauss(300, 3, 40), gauss(50, 3, 41)
    found = nbr.knn_join(table(q), table(x), 6, metric=metric, eps=eps, cells=12, rows_per_block=16)
    d = brute(q, x, metric)
    if eps == 0:
        assert as_lists(found) == nearest_rows(d, 6)
    else:
        last = {r.q_id: r.d for r in found.where("rank = 6").collect()}
        true = np.sort(d, axis=1)[:, 5]
        assert all(last[i] <= true[i] * (1 + eps) + 1e-12 for i in range(50))


@pytest.mark.parametrize("exclude", [False, True])
def test_crowded_copies_are_answered_once_and_whole(table, monkeypatch, exclude):
    monkeypatch.setattr(nbr, "COPIES", 20)
    monkeypatch.setattr(nbr, "REFINE_ROWS", 0 if exclude else 10**9)
    x = np.vstack([gauss(80, 3, 8), np.tile([[0.1, 0.2, 0.3]], (60, 1)), np.tile([[2.0, 2.0, 2.0]], (40, 1))])
    x = x[np.random.default_rng(9).permutation(len(x))]
    found = nbr.knn_join(table(x), table(x), 4, cells=8, rows_per_block=32, exclude_self=exclude)
    assert as_lists(found) == nearest_rows(brute(x, x), 4, skip_self=exclude)


def test_same_answer_on_any_partitioning(table):
    x = gauss(200, 3, 10)
    runs = [as_lists(nbr.knn_join(table(x, partitions=p), table(x, partitions=p), 3, cells=9)) for p in (1, 8)]
    assert runs[0] == runs[1]


def test_cells_are_chosen_where_they_help(table, monkeypatch):
    from manyscale.plans import blocks

    made = []
    keep = blocks.make_cells
    monkeypatch.setattr(blocks, "make_cells", lambda *a: made.append(keep(*a)) or made[-1])
    low, high = gauss(900, 2, 30), gauss(900, 40, 31)
    for x in (low, high):
        got = as_lists(nbr.knn_join(table(x), table(x), 3, rows_per_block=200))
        assert got == nearest_rows(brute(x, x), 3)
    assert made[0].pivots is not None and made[1].pivots is None


def test_padding_and_lists(table):
    q, x = table([[0, 0, 0.1]]), table(CUBE)
    padded = nbr.pad_neighbours(nbr.knn_join(q, x, 31), q, 31, missing_id=8).orderBy("rank").collect()
    assert len(padded) == 31
    assert all(np.isinf(r.d) and r.nbr_id == 8 for r in padded[8:])
    assert not any(np.isinf(r.d) for r in padded[:8])
    lists = nbr.neighbours_within(q, x, 1.0).collect()
    assert len(lists) == 1 and lists[0].nbr_ids[:2] == [0, 1] and lists[0].ds == sorted(lists[0].ds)


def test_wrong_arguments(table):
    for k in (0, -1, None, 1.5):
        with pytest.raises(ValueError):
            nbr.knn_join(table(CUBE), table(CUBE), k)
    with pytest.raises(ValueError):
        nbr.knn_join(table([[0.0, 1.0]]), table(CUBE), 1)
    with pytest.raises(ValueError):
        nbr.count_pairs(table(CUBE), table(CUBE), [[1.0], [2.0]])
    with pytest.raises(ValueError):
        metrics.named("no such metric")


@pytest.mark.parametrize("metric,cells,r", [
    ("euclidean", None, 2.0), ("euclidean", 8, 2.0), ("euclidean", 8, 0.2), ("cityblock", 8, 2.0), ("chebyshev", 8, 2.0)])
def test_range_join_is_sound_and_complete(table, metric, cells, r):
    a, b = gauss(50, 4, 11), gauss(50, 4, 12)
    found = {(p.i, p.j) for p in nbr.range_join(table(a), table(b), r, metric=metric, cells=cells).collect()}
    assert found == set(zip(*np.nonzero(brute(a, b, metric) <= r)))


def test_range_join_with_eps(table):
    a, b, r, eps = gauss(60, 3, 13), gauss(60, 3, 14), 1.5, 0.3
    found = {(p.i, p.j) for p in nbr.range_join(table(a), table(b), r, eps=eps, cells=15).collect()}
    d = brute(a, b)
    assert found <= set(zip(*np.nonzero(d <= r * (1 + eps))))
    assert found >= set(zip(*np.nonzero(d <= r / (1 + eps))))


@pytest.mark.parametrize("cells,r", [(None, 1e-2), (10, 1e-6), (10, 1e-3), (10, 0.1)])
def test_close_pairs_on_clustered_data(table, cells, r):
    x = gauss(300, 4, 15)
    x[:100] *= 0.001
    x[100:200] += 2
    pairs = [(p.i, p.j) for p in nbr.close_pairs(table(x), r, cells=cells).collect()]
    i, j = np.nonzero(brute(x, x) <= r)
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a, b in zip(i, j) if a < b}


def test_single_row_has_no_pairs(table):
    assert nbr.close_pairs(table([[1.0, 2.0]]), 0.5).collect() == []


@pytest.mark.parametrize("whole", [int, float])
def test_grid_ball(spark, whole):
    kind = "int" if whole is int else "double"
    rows = [(4 * i + j, [whole(i), whole(j)]) for i in range(4) for j in range(4)]
    grid = spark.createDataFrame(rows, f"point_id long, x array<{kind}>")
    query = spark.createDataFrame([(0, [whole(2), whole(0)])], f"point_id long, x array<{kind}>")
    assert sorted(nbr.ball_search(query, grid, 1).first().nbr_ids) == [4, 8, 9, 12]


def test_ball_search_keeps_empty_queries(table):
    found = nbr.ball_search(table([[0, 0, 0], [50, 50, 50]]), table(CUBE), 0.5).orderBy("q_id").collect()
    assert [r.nbr_ids for r in found] == [[0], []]


@pytest.mark.parametrize("cells", [None, 12])
def test_pair_counts(table, cells):
    a, b = gauss(50, 2, 16), gauss(50, 2, 17)
    a[10:30] = a[10]
    radii = [10.0, 0.01, 0.2, 0.3, 1000.0, 1.0]
    found = {r.radius: r.n_pairs for r in nbr.count_pairs(table(a), table(b), radii, cells=cells).collect()}
    d = brute(a, b)
    assert found == {r: int((d <= r).sum()) for r in radii}
    assert found[1000.0] == 2500
    one = nbr.count_pairs(table(a), table(b), 0.2, cells=cells).collect()
    assert [(r.radius, r.n_pairs) for r in one] == [(0.2, found[0.2])]


def test_sparse_distances_keep_zeros(table):
    x = gauss(50, 4, 18)
    found = {(p.i, p.j): p.d for p in nbr.sparse_distances(table(x), table(x), 0.3).collect()}
    d = brute(x, x)
    assert set(found) == set(zip(*np.nonzero(d <= 0.3)))
    assert all(found[(i, i)] == 0.0 for i in range(50))


def test_distance_matrix(table):
    a, b = gauss(10, 4, 19), gauss(11, 4, 20)
    found = {(p.i, p.j): p.d for p in nbr.matrix_entries(nbr.distance_matrix(table(a), table(b), rows_per_block=4)).collect()}
    d = brute(a, b)
    assert len(found) == 110 and all(abs(found[i, j] - d[i, j]) < 1e-12 for i in range(10) for j in range(11))
    with pytest.raises(ValueError):
        nbr.distance_matrix(table(a), table(gauss(3, 5, 0)))


def test_metric_values():
    a, b = np.array([[1.0, 0.0]]), np.array([[0.0, 1.0]])
    got = [metrics.named(m).rows(a, b)[0] for m in ("euclidean", "cityblock", "chebyshev")]
    assert np.allclose(got, [np.sqrt(2), 2, 1])
    box = metrics.periodic(1.0)
    assert np.allclose(box.rows(np.array([[0.95]]), np.array([[0.05]])), [0.1])


def test_column_and_block_forms_agree(spark, table):
    a, b = gauss(1, 4, 21), gauss(1, 4, 22)
    pair = table(a).select(F.col("x").alias("u")).crossJoin(table(b).select(F.col("x").alias("v")))
    for m in (metrics.euclidean(), metrics.cityblock(), metrics.chebyshev(), metrics.periodic(1.5)):
        assert abs(pair.select(m.expression(F.col("u"), F.col("v")).alias("d")).first().d - m.rows(a, b)[0]) < 1e-12


def test_strings(spark):
    words = ["hello", "halo", "hallo", "", "yellow", "help", "hello"]
    df = spark.createDataFrame(list(enumerate(words)), "point_id long, x string")
    assert metrics.levenshtein().block(["hello"], ["halo"])[0][0, 0] == 2
    got = {(p.i, p.j): p.d for p in nbr.close_pairs(df, 2, metric="levenshtein", cells=3).collect()}
    spark_d = {(r.i, r.j): r.d for r in df.toDF("i", "u").crossJoin(df.toDF("j", "v")).where("i < j").selectExpr(
        "i", "j", "cast(levenshtein(u, v) as double) d").where("d <= 2").collect()}
    assert got == spark_d
    assert as_lists(nbr.knn_join(df, df, 1, metric="levenshtein", exclude_self=True))[0] == [6]


def test_custom_metric(table):
    x = gauss(40, 2, 23)
    weighted = metrics.custom(lambda p, q: float(2 * abs(p[0] - q[0]) + abs(p[1] - q[1])))
    fast = metrics.custom(lambda a, b: 2 * np.abs(a[:, None, 0] - b[None, :, 0]) + np.abs(a[:, None, 1] - b[None, :, 1]),
                          vectorised=True)
    d = 2 * np.abs(x[:, None, 0] - x[None, :, 0]) + np.abs(x[:, None, 1] - x[None, :, 1])
    for m in (weighted, fast):
        assert as_lists(nbr.knn_join(table(x), table(x), 3, metric=m, cells=5)) == nearest_rows(d, 3)


def test_metric_partitions(table):
    x = gauss(120, 3, 24)
    points = table(x)
    members, summary = nbr.metric_partitions(points, table(x[:9]))
    d = brute(x, x[:9])
    got = {r.point_id: (r.pivot_id, r.d) for r in members.collect()}
    assert {i: p for i, (p, _) in got.items()} == dict(enumerate(d.argmin(axis=1)))
    radii = {r.pivot_id: (r.n, r.radius) for r in summary.collect()}
    assert all(np.isclose(radii[p][1], d[d.argmin(1) == p, p].max()) for p in radii)
    assert [r.violations for r in nbr.check_metric_partitions(points, members, summary).collect()] == [0, 0]
    broken = summary.withColumn("radius", F.col("radius") * 0.5)
    assert nbr.check_metric_partitions(points, members.where("point_id <> 3"), broken).agg(F.min("violations")).first()[0] > 0


def test_lists_do_not_depend_on_blocks(table):
    q, x = gauss(7, 3, 21), gauss(60, 3, 22)
    for search in (lambda n: nbr.ball_search(table(q), table(x), 1.5, segment=16, rows_per_block=n),
                   lambda n: nbr.distance_matrix(table(q), table(x), segment=16, rows_per_block=n)):
        one, many = (sorted(map(repr, search(n).collect())) for n in (1000, 9))
        assert len(one) == len(many) and len(one) > 7
    pairs = {(r.q_id, j) for r in nbr.ball_search(table(q), table(x), 1.5, segment=16, rows_per_block=9).collect() for j in r.nbr_ids}
    assert pairs == set(zip(*(v.tolist() for v in np.nonzero(brute(q, x) <= 1.5))))


# Nested cells


def counted(metric):
    """The metric, and a list that gets the number of distances of each block."""
    asked = []

    def block(a, b):
        asked.append(len(a) * len(b))
        return metric.block(a, b)

    return metrics.Metric(metric.name, block, metric.rows, metric.expression, metric.textual, metric.flat), asked


def measured_here(metric, pivots, x, near=0):
    nest = cells.Cells.nested(metric, pivots, near)
    path, gaps = nest.place(metric, x)
    for level, cell, gap in zip(nest.levels, path, gaps):
        np.add.at(level.rows, cell, 1)
        np.add.at(level.weight, cell, 1)
        np.maximum.at(level.radius, cell, gap * (1 + 1e-12))
        for j, at in cells.grouped(cell) if near else ():
            best = np.sort(gap[at])[:near]
            level.near[j, :len(best)] = best
    return nest, path[-1]


def test_levels_are_nested_and_cover_their_rows():
    x = gauss(3000, 3, 50)
    nest, leaf = measured_here(metrics.euclidean(), x[:600], x)
    assert len(nest.levels) == 2 and nest.levels[-1].rows.sum() == 3000 and len(nest) == 600
    for k, level in enumerate(nest.levels):
        assert level.rows.sum() == 3000
        if k + 1 < len(nest.levels):
            below = nest.levels[k + 1]
            assert np.array_equal(np.add.reduceat(below.rows, level.start[:-1]), level.rows) and (np.diff(level.start) > 0).all()
            own = np.repeat(np.arange(len(level.pivots)), np.diff(level.start))
            assert all(level.pivots[j].tolist() in below.pivots[own == j].tolist() for j in range(len(level.pivots)))
    gap = np.sqrt(((x - nest.pivots[leaf]) ** 2).sum(1))
    assert (gap <= nest.levels[-1].radius[leaf]).all()


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "levenshtein"])
@pytest.mark.parametrize("fan", [3, 48])
def test_walks_keep_every_answer(monkeypatch, metric, fan):
    monkeypatch.setattr(cells, "FAN", fan)
    m = metrics.named(metric)
    if metric == "levenshtein":
        pick = np.random.default_rng(51)
        x = np.array(sorted({"".join(pick.choice(list("abc"), pick.integers(1, 9))) for _ in range(400)}), dtype=object)
        x, r = x[pick.permutation(len(x))], 1.0
    else:
        x, r = gauss(500, 2, 52), 0.3
    q, d = x[:80], cells.exact_block(m, x[:80], x)
    nest, leaf = measured_here(m, x[:120], x, near=4)
    for rule, wanted in ((cells.Within(r), d <= r), (cells.Nearest(4), d <= np.sort(d, axis=1)[:, 3:4]), (cells.Nearest(4, 0.0, r), (d <= np.sort(d, axis=1)[:, 3:4]) & (d <= r))):
        pairs, _, cap = rule.walk(nest, m, q, None, nest.place(m, q)[0])
        visited = set(zip(pairs.row.tolist(), pairs.cell.tolist()))
        assert all((i, leaf[j]) in visited for i, j in zip(*np.nonzero(wanted)))
        assert (cap >= np.minimum(np.sort(d, axis=1)[:, 3], r if rule.__class__ is cells.Within or rule.limit < np.inf else np.inf) - 1e-9).all()
    pairs, _, _ = cells.Nearest(4, 0.5).walk(nest, m, q, None, nest.place(m, q)[0])
    for i in range(len(q)):
        near = np.sort(d[i][np.isin(leaf, pairs.cell[pairs.row == i])])
        assert near[3] <= 1.5 * np.sort(d[i])[3] + 1e-9


def test_routing_costs_a_few_distances_for_each_level():
    x = gauss(20_000, 3, 53)
    metric, asked = counted(metrics.euclidean())
    nest, _ = measured_here(metric, x[:2000], x, near=5)
    assert sum(asked) / len(x) < 150  # of 2,000 leaves
    for rule in (cells.Nearest(5), cells.Within(0.05)):
        asked.clear()
        pairs, _, _ = rule.walk(nest, metric, x[:2000])
        assert sum(asked) / 2000 < 400 and len(pairs.row) / 2000 < 100


@pytest.mark.parametrize("fan", [3, 48])
@pytest.mark.parametrize("kind", ["knn", "range", "close", "count", "count_two"])
def test_nested_joins_equal_brute_force(table, monkeypatch, fan, kind):
    monkeypatch.setattr(cells, "FAN", fan)
    x, y = gauss(260, 3, 54), gauss(200, 3, 55, 0.3)
    x[40:60], y[:15] = x[40], x[40]
    d, self_d = brute(x, y), brute(x, x)
    if kind == "knn":
        assert as_lists(nbr.knn_join(table(x), table(y), 6, cells=40, rows_per_block=16)) == nearest_rows(d, 6)
    elif kind == "range":
        got = nbr.range_join(table(x), table(y), 0.7, cells=40, rows_per_block=16).collect()
        assert sorted((r.i, r.j) for r in got) == sorted(zip(*map(list, np.nonzero(d <= 0.7))))
    elif kind == "close":
        t = table(x)
        got = nbr.close_pairs(t, 0.7, cells=40, rows_per_block=8).collect()
        assert sorted((r.i, r.j) for r in got) == [(i, j) for i, j in zip(*np.nonzero(self_d <= 0.7)) if i < j]
        got = nbr.close_pairs(t, 0.7, rows_per_block=50).collect()
        assert sorted((r.i, r.j) for r in got) == [(i, j) for i, j in zip(*np.nonzero(self_d <= 0.7)) if i < j]
    else:
        radii, t = [0.0, 0.2, 0.9, 2.5, 100.0], table(x)
        other, want = (t, self_d) if kind == "count" else (table(y), d)
        for options in ({"cells": 40, "rows_per_block": 16}, {"cells": 3, "rows_per_block": 8}, {"rows_per_block": 60}, {}):
            got = {r.radius: r.n_pairs for r in nbr.count_pairs(t, other, radii, **options).collect()}
            assert got == {r: int((want <= r).sum()) for r in radii}, options


def test_pairs_of_cells_settle_most_pairs(monkeypatch):
    """Against a table itself: the same counts, and less than 0.6 of the rows that bounds of single rows would send out."""
    x = gauss(4000, 3, 56)
    m, radii = metrics.euclidean(), np.array([0.5, 2.0])
    nest, leaf = measured_here(m, x[:200], x)
    last = nest.levels[-1]
    settled, pairs = cells.cell_pairs(m, nest, nest, radii)
    home, (row, b, lo, hi, was) = blocks.settle_rows(m, x, nest, nest, pairs, radii)
    assert np.array_equal(home, leaf)
    routed = int((lo < hi).sum())
    to_pivots = cells.exact_block(m, x, last.pivots)
    single = int(np.any([(to_pivots - last.radius <= r) & (r < to_pivots + last.radius) for r in radii], axis=0).sum())
    assert routed < 0.6 * single
    d = brute(x, x)
    for t, r in enumerate(radii):
        total = settled[t]
        inside = (hi <= t) & (t < was)
        total += int((last.weight[b[inside]] * np.where(home[row[inside]] != b[inside], 2, 1)).sum())
        for i, c in zip(row[(lo <= t) & (t < hi)], b[(lo <= t) & (t < hi)]):
            total += int((d[i, leaf == c] <= r).sum()) * (2 if home[i] != c else 1)
        assert total == int((d <= r).sum())


def test_nearest_of_many_pivots(table):
    x, p = gauss(300, 3, 57), np.round(gauss(400, 3, 58), 1)
    p[30], p[31] = p[2], p[2]
    members, summary = nbr.metric_partitions(table(x), table(p))
    d = brute(x, p)
    assert {r.point_id: r.pivot_id for r in members.collect()} == {i: int(np.lexsort((np.arange(len(p)), d[i]))[0]) for i in range(len(x))}
    assert summary.agg(F.sum("n")).first()[0] == 300
    with pytest.raises(ValueError):
        nbr.metric_partitions(table(x), table(p), max_pivots=100)
    metric, asked = counted(metrics.euclidean())
    nest = cells.nest_of(metric, gauss(5000, 3, 59))
    asked.clear()
    cells.Nearest(1).walk(nest, metric, gauss(500, 3, 60))
    assert sum(asked) / 500 < 700


# Sketches


@pytest.mark.parametrize("m", [3, 8])
def test_sketch_bounds_hold_for_any_rows(m):
    rng = np.random.default_rng(61)
    sketch = sketches.of_rows(rng.normal(size=(50, 8)) * np.arange(1, 9), m)
    a = np.vstack([rng.normal(size=(40, 8)), rng.normal(size=(5, 8)) * 1e4, np.zeros((1, 8)), 1e-9 * rng.normal(size=(3, 8))])
    b = np.vstack([a[:10], a[:10] + 1e-7, rng.normal(size=(30, 8)) * 5])
    one, two = (sketch.decode(sketch.encode(x)) for x in (a, b))
    assert sketch.encode(a).shape == (len(a), sketch.row_bytes)
    low, high = sketches.bounds(one, two)
    d = brute(a, b)
    assert (low <= d).all() and (d <= high).all()
    assert m < 8 or np.median((high - low)[:40]) < 0.01


@pytest.mark.parametrize("kind", ["knn", "self", "bounded", "range", "close"])
def test_sketched_joins_equal_brute_force_with_half_the_bytes(table, monkeypatch, kind):
    x = gauss(600, 64, 62)
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[500] = x[3]
    d = brute(x, x)
    monkeypatch.setattr(nbr, "SKETCH_ROWS", 0)
    shipped = []
    plain = blocks.dealt
    monkeypatch.setattr(blocks, "dealt", lambda rows: shipped.append(rows) or plain(rows))
    t, r = table(x), float(np.quantile(d, 0.004))
    if kind in ("knn", "self", "bounded"):
        limit = r if kind == "bounded" else np.inf
        got = nbr.knn_join(t, t, 4, rows_per_block=15, exclude_self=kind == "self", distance_upper_bound=limit, payload=["point_id"] if kind == "knn" else [])
        want = nearest_rows(d, 4, kind == "self")
        assert as_lists(got) == {i: ids for i, js in want.items() if (ids := [j for j in js if d[i, j] <= limit])}
        assert all(abs(row.d - d[row.q_id, row.nbr_id]) < 1e-12 for row in got.collect())
    elif kind == "range":
        got = nbr.range_join(t, table(x[:300]), r, rows_per_block=15).collect()
        assert sorted((p.i, p.j) for p in got) == [(i, j) for i, j in zip(*np.nonzero(d[:, :300] <= r))]
    else:
        got = nbr.close_pairs(t, r, rows_per_block=15).collect()
        assert sorted((p.i, p.j) for p in got) == [(i, j) for i, j in zip(*np.nonzero(d <= r)) if i < j]
    coded = shipped[0]
    assert dict(coded.dtypes)["x"] == "binary"
    sizes = coded.agg(F.sum(F.octet_length("x")).alias("bytes"), F.count("x").alias("n")).first()
    pairs = len(got) if isinstance(got, list) else got.count()
    assert sizes.bytes + pairs * (2 * 64 * 8 + sketches.PAIR_BYTES) < 0.5 * sizes.n * 64 * 8


def test_tasks_of_a_join_hold_bounded_blocks_and_tiles(table):
    import pyarrow as pa

    metric = metrics.named("euclidean")
    assert blocks.block_rows(64, metric) * 64 * 8 <= 16 * 2**20
    side = nbr._side(table(gauss(1500, 2, 70)), "point_id", "x", metric)

    def sizes(q, x):
        yield pa.RecordBatch.from_arrays([pa.array([len(q.ids)]), pa.array([len(x.ids)])], names=["n_q", "n_x"])

    met, several = blocks.block_join(side, side, metric, cells.Cells.one(1500), None, sizes, "n_q long, n_x long", rows_per_block=2000, n_queries=200_000)
    tiles = met.collect()
    assert not several and sum(r.n_q * r.n_x for r in tiles) == 1500 * 1500
    assert max(r.n_q * r.n_x for r in tiles) <= 1_000_000


@pytest.mark.parametrize("box", [0.25, 0.3])
def test_periodic_distances_in_bounded_memory(box):
    import tracemalloc

    a, b = gauss(1000, 3, 71), gauss(2000, 3, 72)
    b[0], b[1] = a[0] + box, a[0] + 7 * box / 2
    metric = metrics.periodic(box)
    tracemalloc.start()
    got, slack = metric.block(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert slack == 0 and peak < 40e6  # the distances take 16 MB
    gap = np.mod(np.abs(a[:, None, :] - b[None, :, :]), box)
    gap = np.minimum(gap, box - gap)
    assert (got == np.sqrt((gap * gap).sum(-1))).all()
    assert (metric.rows(a, b[:1000]) == got[np.arange(1000), np.arange(1000)]).all()


def test_ranked_neighbours_travel_as_lists(table):
    x = np.round(gauss(300, 3, 73), 1)
    x[20:40], x[50] = x[20], 100.0
    t, d, r = table(x), brute(x, x), 0.9
    want = {i: sorted((d[i, j], j) for j in np.flatnonzero(d[i] <= r)) for i in range(len(x))}
    for options in ({}, {"rows_per_block": 40}, {"cells": 12, "rows_per_block": 16}):
        found = nbr.neighbours_within(t, t, r, ranked=True, **options)
        got = {}
        for row in found.orderBy("q_id", "rank").collect():
            got.setdefault(row.q_id, []).append((row.rank, row.nbr_id))
            assert abs(row.d - d[row.q_id, row.nbr_id]) < 1e-12
        assert got == {i: [(k, j) for k, (_, j) in enumerate(js, 1)] for i, js in want.items()}, options
        # The lists are shuffled once, before they are opened; single pairs are not.
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(q_id") == 1 and plan.index("Generate explode") < plan.index("hashpartitioning(q_id")
        lists = nbr.ball_search(t, t, r, segment=64, **options).collect()
        assert {(p.q_id, p.segment): p.nbr_ids for p in lists} == {(i, s): [j for _, j in js if j // 64 == s] for i, js in want.items() for s in {j // 64 for _, j in js}}


def test_products_lose_no_pair_and_leave_few_others():
    a, b = gauss(200, 64, 74) / 8, gauss(900, 64, 75) / 8
    b[:50] = a[:50] + gauss(50, 64, 76) * 1e-3
    d = brute(a, b)
    ready = metrics.Products(b)
    for r in (0.8, 1.3, float(d[3, 7])):
        marked = ready.within(a, r)
        assert marked[d <= r].all() and marked.sum() <= (d <= r * 1.001).sum()
    for p, q, r in ((a, b, 0.0), (a, b, 1e-3), (a * 1e9, b, 1.0), (a * 1e-9, b * 1e-9, 1e-9), (a, np.where(d[0, 0] > 0, np.nan, b), 1.0)):
        assert metrics.Products(q).within(p, r) is None


def test_exact_distances_of_many_pairs_in_bounded_memory():
    import tracemalloc

    a, b = gauss(100, 64, 77), gauss(1000, 64, 78)
    rows, cols = np.repeat(np.arange(100), 1000), np.tile(np.arange(1000), 100)
    tracemalloc.start()
    got = cells.exact(metrics.euclidean(), a, b, rows, cols)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6  # the distances take 0.8 MB
    assert (got == metrics.euclidean().rows(a[rows], b[cols])).all()
