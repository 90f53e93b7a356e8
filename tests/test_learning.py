import numpy as np
import pytest
from pyspark.sql import functions as F

from manyscale import streaming
from manyscale.operators import autoencoder as A
from manyscale.operators import classify as C
from manyscale.operators import tree as T


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    middles = np.array([[0.0, 0, 0, 0], [4, 4, 0, 0], [0, 4, 4, 4]])
    rows = [(i, [float(v) for v in middles[i % 3] + rng.normal(scale=0.6, size=4)], [5, 7, 9][i % 3]) for i in range(300)]
    return spark.createDataFrame(rows, "point_id long, x array<double>, label int").repartition(4).cache()


@pytest.mark.parametrize("name", [n for n in sorted(C.CLASSIFIERS) if n not in ("knn_3", "knn_30")])
def test_every_classifier_separates_blobs(blobs, name):
    row = C.classify(blobs, name, 0.3).first()
    assert row.classifier == name and 60 < row.n < 120 and row.accuracy > 90


def test_linear_training_does_not_depend_on_input_partitions(blobs):
    runs = [C.parallel_linear(blobs.repartition(p), "asgd", n_workers=3, rounds=2).weights for p in (1, 7)]
    assert np.allclose(runs[0], runs[1], atol=1e-9)


def test_passive_step_follows_its_rule():
    w, x, signs = np.zeros((1, 3)), np.array([3.0, 4.0, 1.0]), np.array([1.0])
    C.STEPS["passive_aggressive_1"][0](w, x, signs, 1)
    assert np.allclose(w, x / 26.0)
    w = np.zeros((1, 3))
    C.STEPS["passive_aggressive_2"][0](w, x, signs, 1)
    assert np.allclose(w, x / 26.5)


def test_vote_ties_go_to_the_smaller_label(spark):
    train = spark.createDataFrame([(0, [0.0], 9), (1, [2.0], 3), (2, [9.0], 1)], "point_id long, x array<double>, label int")
    test = spark.createDataFrame([(0, [1.0])], "point_id long, x array<double>")
    assert C.knn_classify(train, test, 2).first().prediction == 3


def test_accuracy_and_bad_names(spark, blobs):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "label int, prediction int")
    assert C.accuracy(df).first().accuracy == 75.0
    with pytest.raises(ValueError):
        C.parallel_linear(blobs, "no such algorithm")
    with pytest.raises(ValueError):
        C.parallel_linear(blobs.where("label = 5"), "sgd")


def test_sweep(blobs):
    rows = C.sweep(blobs, ["knn_7"], [1, 2], [1, 2]).collect()
    assert sorted((r.d, r.r) for r in rows) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert all(r.accuracy > 60 for r in rows)


@pytest.mark.parametrize("activation", ["relu", "sigmoid"])
def test_gradients_match_differences(activation):
    rng = np.random.default_rng(1)
    model = A.Autoencoder.random(5, [4, 2], activation, stddev=0.7, seed=3)
    assert [w.shape for w in model.weights] == [(5, 4), (4, 2), (2, 4), (4, 5)]
    x = rng.normal(size=(6, 5))
    _, grads = model.gradients(x)
    for p, g in zip([*model.weights, *model.biases], grads):
        at = tuple(int(rng.integers(s)) for s in p.shape)
        keep = p[at]
        p[at] = keep + 1e-6
        up = model.gradients(x)[0]
        p[at] = keep - 1e-6
        down = model.gradients(x)[0]
        p[at] = keep
        assert abs((up - down) / 2e-6 - g[at]) < 1e-6


@pytest.mark.parametrize("mode,optimizer,activation,lr", [
    ("average", "rmsprop", "sigmoid", 0.01), ("average", "gradient_descent", "sigmoid", 0.5), ("gradient", "rmsprop", "relu", 0.01)])
def test_training_lowers_the_loss(spark, mode, optimizer, activation, lr):
    rng = np.random.default_rng(2)
    x = 1 / (1 + np.exp(-rng.normal(size=(400, 2)) @ rng.normal(size=(2, 6))))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "point_id long, x array<double>")
    model, costs = A.fit_autoencoder(df, [4, 2], activation=activation, optimizer=optimizer, lr=lr, epochs=6, batch=20,
                                     stddev=0.5, mode=mode, n_workers=2, seed=1)
    cost = [r.cost for r in costs.orderBy("epoch").collect()]
    assert len(cost) == 6 and cost[-1] < cost[0]


def test_scoring_and_parameters(spark, table):
    model = A.Autoencoder.random(4, [3, 2], "sigmoid", stddev=0.5)
    x = np.random.default_rng(4).normal(size=(20, 4))
    coded = A.reconstruct(A.encode(table(x), model), model).orderBy("point_id").collect()
    assert np.allclose([r.code for r in coded], model.outputs(x)[2])
    assert np.allclose([r.x_hat for r in coded], model.outputs(x)[4])
    back = A.Autoencoder.from_parameters(model.parameters(spark), "sigmoid")
    assert all(np.array_equal(a, b) for a, b in zip(model.weights + model.biases, back.weights + back.biases))
    error = A.reconstruction_error(A.reconstruct(table(x), model)).first()
    gap = ((model.outputs(x)[4] - x) ** 2).sum()
    assert error.n == 20 and np.isclose(error.total, gap) and np.isclose(error.average, gap / 80)
    with pytest.raises(Exception, match="differs in length"):
        A.reconstruction_error(table(x).withColumn("x_hat", F.slice("x", 1, 2))).collect()


def test_scoring_a_stream(spark, table, tmp_path):
    x = np.random.default_rng(5).normal(size=(60, 4))
    tree = T.fit_tree(table(x), 2, 2)
    table(x).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("point_id long, x array<double>").parquet(str(tmp_path / "in"))
    model = A.Autoencoder.random(4, [3, 2], "sigmoid")
    for at, scored in enumerate([streaming.feature_vectors(stream, tree, new_points=True), streaming.project_points(stream, tree),
                                 streaming.encode(stream, model), streaming.project(stream, tree.cells[0].basis, tree.cells[0].center)]):
        query = scored.writeStream.format("memory").queryName(f"scored{at}").option(
            "checkpointLocation", str(tmp_path / f"c{at}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert spark.table(f"scored{at}").select("point_id").distinct().count() == 60


def test_moments_outlive_an_epoch(spark):
    """One worker trains like a plain run over all epochs, whose moments never start anew."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(130, 6)))], "point_id long, x array<double>").repartition(3)
    model, costs = A.fit_autoencoder(df, [3], activation="sigmoid", lr=0.02, epochs=4, batch=20, stddev=0.4, n_workers=1, seed=2)
    x = np.array([r.x for r in df.selectExpr("*", "xxhash64(point_id, 2) AS o").orderBy("o").collect()])
    plain = A.Autoencoder.random(6, [3], "sigmoid", 0.4, 2)
    parameters = [*plain.weights, *plain.biases]
    moments, seen = [np.ones_like(p) for p in parameters], []
    for _ in range(4):
        total = 0.0
        for s in range(0, len(x), 20):
            loss, gradients = plain.gradients(x[s:s + 20])
            total += loss * len(x[s:s + 20])
            for p, m, g in zip(parameters, moments, gradients):
                m *= 0.9
                m += 0.1 * g * g
                p -= 0.02 * g / np.sqrt(m + 1e-10)
        seen.append(total / len(x))
    assert all(np.allclose(a, b, rtol=0, atol=1e-9) for a, b in zip([*model.weights, *model.biases], parameters))
    assert np.allclose([r.cost for r in costs.orderBy("epoch").collect()], seen, rtol=0, atol=1e-9)


def test_one_join_gives_every_setting(spark, monkeypatch):
    from manyscale.operators import neighbours as N

    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=12).round(1).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    df = spark.createDataFrame(rows, "point_id long, x array<double>, label int").repartition(3)
    train, test = df.where("point_id < 100"), df.where("point_id >= 100")
    joins, join = [], N.blocks.block_join
    monkeypatch.setattr(N.blocks, "block_join", lambda *a, **b: joins.append(1) or join(*a, **b))
    for options in ({}, {"rows_per_block": 13}):
        joins.clear()
        found = N.knn_sweep(test, train, 5, [2, 3], [1, 2, 3], 4, payload=["label"], **options)
        got = {}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            got.setdefault((r["dim"], r["levels"], r.q_id), []).append((r.nbr_id, round(r.d, 9), r.label))
        assert len(joins) == 1 and len(got) == 6 * 50
        for (dim, levels, q), found in got.items():
            cut = np.concatenate([np.arange(4 * j, 4 * j + dim) for j in range(levels)])
            gaps = sorted((float(np.sqrt(((np.array(rows[q][1])[cut] - np.array(x)[cut]) ** 2).sum())), i, c) for i, x, c in rows[:100])[:5]
            assert found == [(i, round(d, 9), c) for d, i, c in gaps]
    for r in C.sweep_knn(train, test, [1, 5], [2, 3], [2], 4).collect():
        cut = F.concat(F.slice("x", 1, r.d), F.slice("x", 5, r.d)).alias("x")
        k = int(r.classifier.removeprefix("knn_"))
        one, two = (part.select("point_id", cut, "label") for part in (train, test))
        assert np.isclose(C.accuracy(two.join(C.knn_classify(one, two, k), "point_id")).first().accuracy, r.accuracy)
    with pytest.raises(ValueError):
        N.knn_sweep(test, train, 5, [2], [4], 4)


def exact_machine(x, y, cost, gamma):
    """The two-class problem by many small projected steps on all weights, for comparison."""
    from manyscale.operators import kernel_machines as K

    q = K.kernel(x, x, gamma) * np.outer(y, y)
    alpha, rate = np.zeros(len(y)), 1.0 / np.linalg.eigvalsh(q)[-1]
    ahead, momentum = alpha.copy(), 1.0
    for _ in range(6_000):
        moved = ahead + rate * (1 - q @ ahead)
        low, high = -1e3, 1e3
        for _ in range(50):  # the shift that keeps the signed sum at zero
            mid = (low + high) / 2
            low, high = (mid, high) if y @ np.clip(moved - mid * y, 0, cost) > 0 else (low, mid)
        new = np.clip(moved - low * y, 0, cost)
        after = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead, alpha, momentum = new + (momentum - 1) / after * (new - alpha), new, after
    free = (alpha > 1e-6) & (alpha < cost - 1e-6)
    bias = (y - (K.kernel(x, x, gamma) @ (alpha * y)))[free].mean()
    return lambda z: K.kernel(z, x, gamma) @ (alpha * y) + bias


def test_kernel_scores_in_bounded_memory():
    import tracemalloc

    from manyscale.operators import kernel_machines as K

    rng = np.random.default_rng(3)
    x, v, w = rng.normal(size=(10_000, 4)), rng.normal(size=(6_000, 4)), rng.normal(size=(2, 6_000))
    tracemalloc.start()
    got = K.scores(x, v, w, np.array([1.0, -1.0]), 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # the whole kernel takes 480 MB
    assert np.allclose(got[:50], K.kernel(x[:50], v, 0.3) @ w.T + [1.0, -1.0])


def test_solving_on_from_the_weights_of_two_parts():
    from manyscale.operators import kernel_machines as K

    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = np.where(x[:, 0] + rng.normal(size=200) > 0, 1.0, -1.0)
    parts = [K.solve(x[at], y[at], 1.0, 0.5, 1e-6)[0] for at in (slice(0, 100), slice(100, 200))]
    cold, warm, off = (K.solve(x, y, 1.0, 0.5, 1e-6, start) for start in (None, np.concatenate(parts), np.ones(200) * (y > 0)))
    for alpha, bias in (warm, off):  # a start whose signed sum is not zero is not used
        assert np.abs(alpha - cold[0]).max() < 1e-3 and abs(bias - cold[1]) < 1e-3 and abs(alpha @ y) < 1e-9


@pytest.mark.parametrize("part_rows", [1000, 40])
def test_cascade_equals_an_exact_solver(spark, part_rows):
    from manyscale.operators import kernel_machines as K

    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 2)) * 1.5
    label = (np.hypot(*x.T) > 1.6).astype(int) + (x[:, 0] > 1.5) + (rng.random(150) < 0.05)
    df = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(150)], "point_id long, x array<double>, label int").repartition(4)
    model = K.fit_kernel_machine(df, cost=2.0, gamma=0.7, part_rows=part_rows, tolerance=1e-4)
    assert model.violations == 0 and (model.rounds == 1 or part_rows == 40)
    got = np.array([r.decisions for r in model.decisions(df).orderBy("point_id").collect()])
    for c, name in enumerate(model.classes):
        want = exact_machine(x, np.where(label == name, 1.0, -1.0), 2.0, 0.7)
        assert np.abs(got[:, c] - want(x)).max() < 5e-3
        assert abs(model.weights[c].sum()) < 1e-9 and np.abs(model.weights[c]).max() <= 2.0
    predicted = model.predict(df).orderBy("point_id").collect()
    assert [r.prediction for r in predicted] == [model.classes[k] for k in got.argmax(axis=1)]


def test_overlapping_classes_are_merged_at_once(spark):
    from manyscale.operators import kernel_machines as K

    rng = np.random.default_rng(11)
    x = rng.normal(size=(1200, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1100:] = x[1100] + 1e-4 * x[1100:]  # near copies
    label = np.where(rng.random(1200) < 0.7, rng.integers(0, 3, 1200), (x[:, 0] > 0) + 1)
    df = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(1200)], "point_id long, x array<double>, label int").repartition(4)
    model = K.fit_kernel_machine(df, part_rows=64)
    # Support vectors of a class fill more than four parts, so no task holds them; nothing is left for a second round.
    assert (model.weights != 0).sum(axis=1).max() > 4 * 64 and (model.violations, model.rounds) == (0, 1)
    got = model.decisions(df).orderBy("point_id").collect()
    for c, name in enumerate(model.classes):
        y = np.where(label == name, 1.0, -1.0)
        alpha, bias = K.solve(x, y, 1.0, 1 / 6)
        want = K.scores(x, x, (alpha * y)[None, :], bias, 1 / 6)[:, 0]
        assert np.abs(np.array([r.decisions[c] for r in got]) - want).max() < 5e-3
        assert abs(model.weights[c].sum()) < 1e-6 and np.abs(model.weights[c]).max() <= 1.0
        weights = np.zeros(1200)
        weights[model.ids] = np.abs(model.weights[c])
        margin = y * want
        assert (weights[margin > 1.01] == 0).all() and (weights[margin < 0.99] == 1).all()
