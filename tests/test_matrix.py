import numpy as np
import pytest
from pyspark.sql import functions as F

from manyscale.operators import decomposition as D
from manyscale.operators import matrix as M

SMALL = np.array([[0.0, 1, 0, 7, 0], [2, 0, 3, 4, 5], [4, 0, 0, 6, 7]])


@pytest.fixture
def rows(table):
    return lambda m: table(m).withColumnRenamed("point_id", "i")


def dense(df):
    found = df.orderBy("i").collect()
    assert [r.i for r in found] == list(range(len(found)))
    return np.array([r.x for r in found])


def from_entries(df):
    found = df.collect()
    out = np.zeros((max(r.i for r in found) + 1, max(r.j for r in found) + 1))
    for r in found:
        out[r.i, r.j] = r.v
    return out


def rand(*shape, seed=0):
    return np.random.default_rng(seed).normal(size=shape)


def test_elementwise(rows):
    a, b = rand(7, 4), rand(7, 4, seed=1)
    assert np.allclose(dense(M.matrix_add(rows(a), rows(b))), a + b)
    assert np.allclose(dense(M.matrix_scale(rows(a), -2.5)), -2.5 * a)
    assert np.allclose(dense(M.subtract_vector(rows(a), [1, 2, 3, 4])), a - [1, 2, 3, 4])
    assert np.allclose(dense(M.center_columns(rows(a))), a - a.mean(0))
    assert np.allclose(M.column_means(rows(a)).first().x, a.mean(0))
    assert np.allclose([r["mean"] for r in M.row_means(rows(a)).orderBy("i").collect()], a.mean(1))
    assert M.matrix_size_kb(rows(a)).first().kb == 7 * 4 * 8 / 1024
    with pytest.raises(ValueError):
        M.matrix_add(rows(a), rows(rand(6, 4)))
    with pytest.raises(ValueError):
        M.matrix_add(rows(a), rows(rand(7, 5)))


def test_transpose(rows):
    a = rand(23, 4)
    pieces = M.matrix_transpose(rows(a), segment=5).collect()
    out = np.zeros((4, 23))
    for p in pieces:
        assert len(p.js) <= 5
        out[p.i, p.js] = p.x
    assert np.array_equal(out, a.T)
    assert np.array_equal(from_entries(M.transpose_entries(M.to_entries(rows(a)))), a.T)


def test_products(rows, spark):
    a, b, v = rand(23, 9), rand(9, 6, seed=2), rand(9, seed=3)
    assert np.allclose(dense(M.matrix_multiply(rows(a), rows(b))), a @ b)
    assert np.allclose(from_entries(M.multiply_entries(M.to_entries(rows(a)), M.to_entries(rows(b)))), a @ b)
    got = [r.y for r in M.matrix_vector(rows(a), v).orderBy("i").collect()]
    assert np.allclose(got, a @ v)
    assert np.array_equal(from_entries(M.identity(spark, 5)), np.eye(5))
    with pytest.raises(ValueError):
        M.matrix_multiply(rows(a), rows(a))
    with pytest.raises(ValueError):
        M.matrix_vector(rows(a), [1.0])


@pytest.mark.parametrize("block", [4, 5, 64])
def test_block_product_equals_the_broadcast_product(rows, block):
    a, b = rand(23, 9), rand(9, 11, seed=2)
    blocks = M.to_blocks(rows(a), block, block)
    assert all(r.height <= block and r.width <= block for r in blocks.collect())
    assert np.array_equal(dense(M.from_blocks(blocks)), a)
    assert np.allclose(dense(M.matrix_multiply(rows(a), rows(b), block=block, small_side=0)), a @ b)


def test_covariance_and_pca_golden(table):
    cov = from_entries(D.covariance(table(SMALL)))
    assert np.allclose(cov, np.cov(SMALL.T, bias=True))
    axes = D.pca(table(SMALL), 2)
    assert np.allclose(axes.eigenvalues, [12.0041647, 3.1069464, 0, 0, 0], atol=1e-6)
    assert abs(D.variance_explained(table(SMALL), 1) - 0.794393) < 1e-6
    scores = {r.point_id: r.scores for r in axes.scores(table(SMALL)).collect()}
    assert np.allclose([scores[i] for i in range(3)], SMALL @ axes.components.T)
    far = rand(500, 6) + 1e6
    assert np.allclose(from_entries(D.covariance(table(far))), np.cov(far.T, bias=True), atol=1e-8)


def test_library_pca_and_svd_golden(table):
    projected = D.ml_pca(table(SMALL), 2).select("point_id", F.col("pca_features").alias("x"))
    f = D.truncated_svd(projected, 2, compute_u=True)
    assert np.allclose(f.s, [9.491, 4.6253], atol=1e-3)
    u = np.array([r.u for r in f.u.orderBy("point_id").collect()])
    assert np.allclose(np.abs(u), np.abs([[.1129, -.909], [.463, .4055], [.8792, -.0968]]), atol=1e-3)
    assert np.allclose(D.truncated_svd(table(SMALL), 2).s, [13.0292755, 5.3685787])


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_svd_reconstructs(table, partitions):
    a = rand(200, 3) @ rand(3, 8, seed=4)
    points = table(a, partitions=partitions)
    f = D.truncated_svd(points, 8, compute_u=True)
    assert len(f.s) == 3
    u = np.array([r.u for r in f.u.orderBy("point_id").collect()])
    assert np.allclose(u * f.s @ f.v.T, a) and np.allclose(u.T @ u, np.eye(3))
    g = D.incremental_svd(points, 3, compute_u=True)
    u = np.array([r.u for r in g.u.orderBy("point_id").collect()])
    assert np.allclose(g.s, f.s) and np.allclose(u * g.s @ g.v.T, a)


def test_incremental_svd_is_close_on_decaying_data(table):
    a = rand(400, 10) * 2.0 ** -np.arange(10)
    true = np.linalg.svd(a, compute_uv=False)[:4]
    assert np.allclose(D.incremental_svd(table(a), 4).s, true, rtol=0.02)


def test_projection_and_reconstruction(table):
    basis = np.linalg.qr(rand(6, 6))[0][:2]
    a, c = rand(30, 6, seed=5), rand(6, seed=6)
    z = np.array([r.z for r in D.project(table(a), basis, c).orderBy("point_id").collect()])
    assert np.allclose(z, (a - c) @ basis.T)
    hat = D.affine_reconstruct(table(a), basis, c)
    x_hat = np.array([r.x_hat for r in hat.orderBy("point_id").collect()])
    assert np.allclose(x_hat, (a - c) @ D.projector(basis) + c)
    again = D.project(hat.select("point_id", F.col("x_hat").alias("x")), basis, c)
    assert np.allclose(np.array([r.z for r in again.orderBy("point_id").collect()]), z)
    for bad in (lambda: D.project(table(a), basis[:, :3]), lambda: D.project(table(a), basis, c[:3])):
        with pytest.raises(ValueError):
            bad()


def test_add_refuses_different_row_indices(spark):
    a = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "i long, x array<double>")
    b = a.selectExpr("i + 10 AS i", "x")
    with pytest.raises(Exception, match="only one matrix has row"):
        M.matrix_add(a, b).collect()
    assert sorted((r.i, r.x) for r in M.matrix_add(a, a).collect()) == [(i, [2.0, 4.0]) for i in range(6)]


def test_product_keeps_row_indices_both_ways(spark):
    a, b = np.arange(18.0).reshape(6, 3), np.arange(12.0).reshape(3, 4)
    left = spark.createDataFrame([(10 * i, r.tolist()) for i, r in enumerate(a)], "i long, x array<double>")
    right = spark.createDataFrame(list(enumerate(b.tolist())), "i long, x array<double>")
    for small_side in (0, 1 << 20):
        found = {r.i: r.x for r in M.matrix_multiply(left, right, block=8, small_side=small_side).collect()}
        assert sorted(found) == [0, 10, 20, 30, 40, 50]
        assert np.allclose([found[10 * i] for i in range(6)], a @ b)
        with pytest.raises(ValueError):
            M.matrix_multiply(left, right.withColumn("i", F.col("i") * 2), block=8, small_side=small_side)


def planted(rows, width, values, seed):
    """Centered rows whose covariance has the given eigenvalues, and its directions."""
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(rows, len(values)))
    u -= u.mean(axis=0)
    u = np.linalg.qr(u)[0]
    v = np.linalg.qr(rng.normal(size=(width, len(values))))[0].T
    return u * np.sqrt(np.array(values) * rows) @ v, v


def test_covariance_in_tiles(table, monkeypatch):
    x = np.random.default_rng(3).normal(size=(40, 300)) + 5
    want = np.cov(x.T, bias=True)
    monkeypatch.setattr(D, "FLUSH_VALUES", 20_000)
    monkeypatch.setattr(D, "TILE_ROWS_VALUES", 3000)
    # Tiles of 290 columns have more values than a segment, which then ends within a row.
    for tile in (64, 290, 300):
        got = np.full((300, 300), np.nan)
        for r in D.covariance_tiles(table(x), tile=tile).collect():
            i, j = r.bi * tile + r.row, r.bj * tile
            assert np.isnan(got[i, j : j + len(r.v)]).all()
            got[i, j : j + len(r.v)] = r.v
            if r.bi < r.bj:
                got[j : j + len(r.v), i] = r.v
        assert np.allclose(got, want)
    small = D.tile_entries(D.covariance_tiles(table(x[:, :7]), tile=3), 3)
    assert small.count() == 49 and np.allclose(from_entries(small), want[:7, :7])


def test_wide_tables_never_form_a_square_matrix(table):
    values = [9.0, 4.0, 2.5, 1.0, 0.25, 0.1]
    x, v = planted(60, 20_000, values, 4)
    points = table(x, partitions=3).cache()
    axes = D.pca(points, 3)
    assert np.allclose(axes.eigenvalues, values[:3]) and abs(axes.total - sum(values)) < 1e-8
    assert np.allclose(np.abs((axes.components * v[:3]).sum(axis=1)), 1.0)
    assert abs(D.variance_explained(points, 2) - 13 / sum(values)) < 1e-9
    svd = D.truncated_svd(points, 4)
    assert np.allclose(svd.s, np.sqrt(np.array(values[:4]) * 60))
    some = points.select("point_id", F.slice("x", 1, 3000).alias("x"))
    tiles = D.covariance_tiles(some)
    facts = tiles.select(F.sum(F.expr("CASE WHEN bi = bj THEN v[row] END")).alias("trace"),
                         F.sum(F.expr("aggregate(v, 0D, (a, e) -> a + e * e) * CASE WHEN bi = bj THEN 1 ELSE 2 END")).alias("squares")).first()
    inner = np.linalg.svd(x[:, :3000], compute_uv=False) ** 2 / 60
    assert abs(facts.trace - inner.sum()) < 1e-6 and abs(facts.squares - (inner ** 2).sum()) < 1e-6
    points.unpersist()


@pytest.mark.parametrize("size,partitions", [(1, 1), (4, 9), (12, 40)])
def test_frequent_directions_keep_their_bound(table, size, partitions):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(700, 12)) * 2.0 ** -np.arange(12) + np.outer(rng.random(700) > 0.99, rng.normal(size=12) * 5)
    sketch = D.frequent_directions(table(a, partitions=partitions), size)
    assert sketch.b.shape == (size, 12) and np.isclose(sketch.energy, (a * a).sum())
    off = np.linalg.eigvalsh(a.T @ a - sketch.b.T @ sketch.b)
    assert off[0] >= -1e-8 and off[-1] <= sketch.bound + 1e-8
    s = np.linalg.svd(a, compute_uv=False)
    for k in range(size):
        assert sketch.bound <= (s[k:] ** 2).sum() / (size + 1 - k) + 1e-8
    assert size < 12 or sketch.bound < 1e-8
    top, v = sketch.top(size)
    assert (top <= s[:size] + 1e-8).all() and (s[:size] ** 2 - top ** 2 <= sketch.bound + 1e-8).all() and v.shape == (12, size)


def test_heavy_inner_indices_are_split_in_two_dimensions(spark):
    rng = np.random.default_rng(7)
    entry = lambda rows: spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in rows], "i long, j long, v double").repartition(5)
    a = [(i, 3, 1.0 + i) for i in range(400)] + [(int(i), int(k), 0.5) for i, k in zip(rng.integers(0, 400, 400), rng.integers(4, 60, 400))]
    b = [(3, j, 2.0 - j) for j in range(300)] + [(int(k), int(j), 0.25) for k, j in zip(rng.integers(4, 60, 300), rng.integers(0, 300, 300))]
    left, right = M.split_heavy(entry(a), entry(b), 50)
    for side, columns in ((left, "sa"), (right, "sb")):
        sizes = {tuple(r[:3]): r["count"] for r in side.groupBy("k", "sa", "sb").count().collect()}
        assert max(sizes.values()) < 100 and len([k for k in sizes if k[0] == 3]) == 8 * 6
    light = M.split_heavy(entry(a), entry(b))[0]
    assert light.count() == len(a) and light.where("sa <> 0 OR sb <> 0").count() == 0
    got = {(r.i, r.j): r.v for r in M.multiply_entries(entry(a), entry(b), 50).collect()}
    assert M.multiply_entries(entry(a), entry(b)).count() == len(got)
    want = {}
    for i, k, v in a:
        for kk, j, w in b:
            if k == kk:
                want[i, j] = want.get((i, j), 0.0) + v * w
    assert got.keys() == want.keys() and all(np.isclose(got[key], want[key]) for key in want)
