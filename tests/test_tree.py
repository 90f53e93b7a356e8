import numpy as np
import pytest
from pyspark.sql import functions as F

from manyscale.functions import linear
from manyscale.operators import tree as T
from manyscale.sources import models

SIZES = {
    "sf0.001": [500, 261, 239, 164, 97, 118, 121, 99, 65, 45, 52, 67, 51, 62, 59],
    "sf0.01": [500, 265, 235, 144, 121, 122, 113, 91, 53, 54, 67, 64, 58, 62, 51],
    "sf0.1": [2000, 988, 1012, 505, 483, 459, 553, 286, 219, 243, 240, 259, 200, 254, 299],
}
ERRORS = {
    "sf0.001": [0.013543, 0.012953, 0.012069, 0.010797],
    "sf0.01": [0.013521, 0.012862, 0.012019, 0.010788],
    "sf0.1": [0.014028, 0.013649, 0.013186, 0.012572],
}


def embeddings(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("x"), "label")


@pytest.fixture(scope="module")
def fitted(spark):
    points = embeddings(spark, "sf0.001").cache()
    return points, T.fit_tree(points, 5, 3)


def level_errors(points, tree):
    gap = F.aggregate(F.zip_with("x", "x_hat", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    rows = T.reconstructions(points, tree).join(points, "point_id").groupBy("level").agg(F.avg(gap / F.size("x")).alias("e"))
    return [r.e for r in rows.orderBy("level").collect()]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_expected_cells_and_errors(spark, sf):
    points = embeddings(spark, sf)
    tree = T.fit_tree(points, 5, 3)
    assert [tree.cells[k].n for k in range(15)] == SIZES[sf]
    assert np.allclose(level_errors(points, tree), ERRORS[sf], atol=1e-6)


@pytest.mark.parametrize("local,factors", [(0, T.FACTOR_BYTES), (150, T.FACTOR_BYTES), (0, 1)])
def test_every_route_gives_the_same_tree(fitted, local, factors):
    points, tree = fitted
    other = T.fit_tree(points.repartition(7), 5, 3, max_local_rows=local, factor_bytes=factors)
    assert {k: c.n for k, c in tree.cells.items()} == {k: c.n for k, c in other.cells.items()}
    assert all(np.allclose(c.center, other.cells[k].center) for k, c in tree.cells.items())
    assert np.allclose(level_errors(points, tree), level_errors(points, other), atol=1e-9)
    assert all(np.allclose(c.svals, other.cells[k].svals) for k, c in tree.cells.items())
    assert all(np.allclose(c.basis, other.cells[k].basis, atol=1e-7) for k, c in tree.cells.items())


def test_both_routes_agree_on_wide_rows(table):
    """The width of a real trajectory, with more and with fewer rows than columns in a cell."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 6)) * [9, 7, 5, 4, 3, 2] @ rng.normal(size=(6, 2676)) + 0.01 * rng.normal(size=(160, 2676)) + 3.0
    points = table(x, partitions=3)
    one, two = T.fit_tree(points, 4, 2), T.fit_tree(points, 4, 2, max_local_rows=0, factor_bytes=1)
    assert one.cells.keys() == two.cells.keys() and len(one.cells) == 7
    for k, c in one.cells.items():
        other = two.cells[k]
        assert c.n == other.n and np.allclose(c.center, other.center) and np.allclose(c.svals, other.svals) and np.allclose(c.basis, other.basis, atol=1e-8)


def test_a_deep_tree_takes_memory_for_its_cells_only():
    """27 levels down one side, and ids close to the largest that 64 bits hold."""
    for depth, side in ((27, 2), (61, 2), (61, 1)):
        centers, k = {}, 0
        for level in range(depth):
            for s in (1, 2):
                centers[2 * k + s] = np.array([level + 1.0 if s == side else -1.0 - level])
            k = 2 * k + side
        router = T.Router.build(centers, 1)
        assert router.n_bytes < 100 * depth
        path = router.path(np.array([[1000.0], [-1000.0], [3.2]]))
        assert path[-1][0] == k and path[-1][1] == (3 - side) and len(path) == depth + 1
        assert T.level_of(int(path[-1][0])) == depth


def test_ancestors_of_large_ids(spark):
    ids = [0, 5, 2 ** 53 + 1, 2 ** 61 - 3, 2 ** 62 - 2]
    got = spark.createDataFrame([(k,) for k in ids], "node_id long").select("node_id", T.ancestor_ids(F.col("node_id")).alias("up")).collect()
    for r in got:
        up, k = [], r.node_id
        while k:
            k = (k - 1) // 2
            up.append(k)
        assert sorted(r.up) == sorted(up)


def test_wide_route_finds_a_low_rank_plane(table):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 40)) + 5.0
    points = table(x)
    tree = T.fit_tree(points, 3, 1, max_local_rows=0, factor_bytes=1)
    assert max(level_errors(points, tree)) < 1e-18
    assert all(np.allclose(c.basis @ c.basis.T, np.eye(3), atol=1e-9) for c in tree.cells.values())


def test_representations(fitted):
    points, tree = fitted
    data = {r.point_id: np.array(r.x) for r in points.collect()}
    reps = T.representations(points, tree).collect()
    assert len(reps) == 500 * 4
    for r in reps[::37]:
        cell = tree.cells[r.node_id]
        assert np.allclose(r.z, cell.basis @ (data[r.point_id] - cell.center))
    counts = {}
    for r in reps:
        counts[r.node_id] = counts.get(r.node_id, 0) + 1
    assert counts == {k: c.n for k, c in tree.cells.items()}


def test_projecting_new_points(fitted, table):
    _, tree = fitted
    new = np.random.default_rng(1).normal(size=(40, 64)) * 0.125
    got = {(r.point_id, r.level): (r.node_id, r.z) for r in T.project_points(table(new), tree).collect()}
    level = {(r.point_id, r.level): r.node_id for r in T.project_points_by_level(table(new), tree).collect()}
    for i, x in enumerate(new):
        k = 0
        for j in range(4):
            node, z = got[i, j]
            assert node == k and np.allclose(z, tree.cells[k].basis @ (x - tree.cells[k].center))
            ids = range(2**j - 1, 2 ** (j + 1) - 1)
            assert level[i, j] == min(ids, key=lambda c: (np.linalg.norm(tree.cells[c].center - x), c))
            if j < 3:
                gaps = [np.linalg.norm(tree.cells[2 * k + s].center - x) for s in (1, 2)]
                k = 2 * k + 1 + (gaps[0] > gaps[1])


def test_features_with_and_without_shuffle(fitted):
    points, tree = fitted
    direct = {r.point_id: r.x for r in T.feature_vectors(points, tree, 3, 4).collect()}
    grouped = {r.point_id: r.x for r in T.multiscale_features(T.representations(points, tree), 3, 4).collect()}
    assert direct.keys() == grouped.keys()
    assert all(len(direct[k]) == 12 and np.allclose(direct[k], grouped[k]) for k in direct)


def test_model_larger_than_a_broadcast_is_applied_in_passes(fitted, monkeypatch):
    points, tree = fitted
    whole = {(r.point_id, r.level): r.z for r in T.representations(points, tree).collect()}
    monkeypatch.setattr(T.storage, "BROADCAST_LIMIT", 40_000)
    assert len(T._basis_groups(tree)) > 1
    parts = {(r.point_id, r.level): r.z for r in T.representations(points, tree).collect()}
    assert whole == parts
    assert T.feature_vectors(points, tree).count() == 500


@pytest.mark.parametrize("local,factors", [(150, T.FACTOR_BYTES), (0, 1)])
def test_many_cells_are_fitted_in_passes(fitted, monkeypatch, local, factors):
    points, tree = fitted
    monkeypatch.setattr(T.storage, "BROADCAST_LIMIT", 20_000)
    other = T.fit_tree(points, 5, 2, max_local_rows=local, factor_bytes=factors)
    assert {k: c.n for k, c in other.cells.items()} == {k: tree.cells[k].n for k in other.cells} and len(other.cells) == 7
    assert all(c.basis.shape == (5, 64) for c in other.cells.values())


def test_early_leaves_are_filled(spark):
    reps = spark.createDataFrame([(1, 0, 0, [1.0, 2.0]), (1, 1, 1, [3.0]), (2, 0, 0, [4.0, 5.0]), (2, 1, 2, [6.0, 7.0]), (2, 2, 5, [8.0, 9.0, 10.0])],
                                 T.REP_SCHEMA)
    got = {r.point_id: r.x for r in T.multiscale_features(reps, 3, 2).collect()}
    assert got == {1: [1.0, 2.0, 3.0, 0.0, 3.0, 0.0], 2: [4.0, 5.0, 6.0, 7.0, 8.0, 9.0]}


@pytest.mark.parametrize("limit", [2**29, 40_000])
def test_wavelets_telescope(fitted, monkeypatch, limit):
    points, tree = fitted
    monkeypatch.setattr(T.storage, "BROADCAST_LIMIT", limit)
    rec = {(r.point_id, r.level): np.array(r.x_hat) for r in T.reconstructions(points, tree).collect()}
    total = {}
    for r in T.wavelets(points, tree).collect():
        total[r.point_id] = total.get(r.point_id, 0) + np.array(r.q)
    assert all(np.allclose(rec[p, 0] + total[p], rec[p, 3]) for p in total) and len(total) == 500


def test_wavelet_bases(spark, fitted):
    _, tree = fitted
    for r in T.wavelet_bases(tree.nodes(spark)).collect():
        up, down = tree.cells[(r.node_id - 1) // 2].basis, tree.cells[r.node_id].basis
        assert np.allclose(np.array(r.psi), (down.T - up.T @ up @ down.T).T)


def test_partition_properties(fitted):
    points, tree = fitted
    reps = T.representations(points, tree)
    rows = T.check_partition(reps, 4).orderBy("level").collect()
    assert [(r.n_points, r.n_cells, r.violations) for r in rows] == [(500, 2**j, 0) for j in range(4)]
    moved = reps.withColumn("node_id", F.expr("case when point_id = 7 and level = 1 then 3 - node_id else node_id end"))
    assert T.check_partition(moved, 4).agg(F.sum("violations")).first()[0] > 0
    sizes = T.level_sizes(reps, 64).orderBy("level").collect()
    assert [r.max_points for r in sizes] == [500, 261, 164, 99] and sizes[0].max_kb == 500 * 64 * 8 / 1024


def flat_points():
    """Two far groups on one line: both halves have the same one-dimensional plane."""
    t = np.concatenate([np.linspace(0, 1, 40), np.linspace(10, 11, 40)])
    return np.outer(t, [1.0, 2.0, 2.0]) / 3.0


@pytest.mark.parametrize("local,against", [(None, "sibling"), (None, "parent"), (0, "sibling")])
def test_pruning_flat_data(table, local, against):
    points = table(flat_points())
    tree = T.fit_tree(points, 2, 3, max_local_rows=local, against=against)
    assert set(tree.cells) == {0} and tree.is_leaf(0)
    assert len(T.fit_tree(points, 2, 2, prune=None, max_local_rows=local).cells) == 7


def test_pruning_a_node_table(spark, table):
    nodes = T.fit_tree(table(flat_points()), 2, 2, prune=None).nodes(spark)
    kept = T.prune_cells(nodes).collect()
    assert [(r.node_id, r.is_leaf) for r in kept] == [(0, True)]
    cosines = T.subspace_cosines(nodes).collect()
    assert all(abs(r.cosine - 1) < 1e-9 for r in cosines)
    assert T.prune_cells(nodes, eps=1.5).count() == 7


def test_tiny_and_equal_cells(table):
    tree = T.fit_tree(table([[0.0, 0.0], [1.0, 0.0], [5.0, 5.0]]), 2, 4)
    assert sorted(c.n for k, c in tree.cells.items() if tree.is_leaf(k)) == [1, 1, 1]
    same = T.fit_tree(table(np.ones((20, 3))), 2, 3)
    assert set(same.cells) == {0} and same.cells[0].svals.tolist() == [0.0, 0.0]


def test_bad_input(spark, table):
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "point_id long, x array<double>")
    with pytest.raises(ValueError):
        T.fit_tree(ragged, 1, 1)
    with pytest.raises(ValueError):
        T.fit_tree(table([[1.0, 2.0]]).where("point_id < 0"), 1, 1)


def test_save_load_and_export(spark, fitted, tmp_path):
    points, tree = fitted
    reps = T.representations(points, tree)
    models.save_model(spark, tree, str(tmp_path / "m"), reps)
    back = models.load_model(spark, str(tmp_path / "m"))
    assert back.cells.keys() == tree.cells.keys() and back.d == tree.d
    for k, c in tree.cells.items():
        assert np.array_equal(c.center, back.cells[k].center) and np.array_equal(c.basis, back.cells[k].basis)
    assert models.load_representations(spark, str(tmp_path / "m")).exceptAll(reps).count() == 0
    models.export_model_text(tree.nodes(spark), str(tmp_path / "t"), reps)
    lines = spark.read.option("header", True).csv(str(tmp_path / "t" / "centers"))
    got = {int(r.node_id): [float(v) for v in r["values"].split()] for r in lines.collect()}
    assert np.allclose(got[3], tree.cells[3].center)
    assert spark.read.option("header", True).csv(str(tmp_path / "t" / "bases")).count() == 15 * 5


def test_cosine_helpers():
    a, b = np.eye(4)[:2], np.eye(4)[[1, 0]]
    assert linear.subspace_cosine(a, b) == 0.0 and linear.rotation_free_cosine(a, b) == 1.0
