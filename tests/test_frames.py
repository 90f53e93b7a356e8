import numpy as np
import pytest
from pyspark.sql import functions as F

from manyscale.operators import labels as L
from manyscale.operators import neighbours
from manyscale.sources import frames as S


@pytest.fixture(scope="module")
def frames(spark):
    xyz = np.random.default_rng(0).normal(size=(40, 5, 3))
    rows = [(0, i, f.tolist()) for i, f in enumerate(xyz)]
    return xyz, spark.createDataFrame(rows, "traj_id int, frame_no long, coords array<array<double>>").repartition(3).cache()


def test_read_and_slice(spark, frames, tmp_path):
    _, df = frames
    df.write.parquet(str(tmp_path / "f"))
    got = S.read_frames(spark, str(tmp_path / "f"), 5, 30, 10)
    assert sorted(r.frame_no for r in got.collect()) == [5, 15, 25]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(frame_no,5)" in plan and "LessThan(frame_no,30)" in plan
    assert S.downsample(df, 10, "frame_no").count() == 4
    both = S.union_trajectories([df.drop("traj_id"), df.drop("traj_id")])
    assert both.groupBy("traj_id").count().orderBy("traj_id").collect() == [(0, 40), (1, 40)]
    for bad in (lambda: S.select_frames(df, step=0), lambda: S.downsample(df, 0)):
        with pytest.raises(ValueError):
            bad()


def test_flatten_fold_and_explode(frames):
    xyz, df = frames
    flat = S.flatten_frames(df)
    assert np.allclose([r.x for r in flat.orderBy("frame_no").collect()], xyz.reshape(40, 15))
    assert S.fold_frames(flat).select("frame_no", "coords").exceptAll(df.select("frame_no", "coords")).count() == 0
    atom = S.explode_atoms(df).where("frame_no = 3 and atom = 2").first()
    assert np.allclose(atom.x, xyz[3, 2])


def test_select_atoms(spark, frames):
    xyz, df = frames
    topology = spark.createDataFrame([(0, "alpha"), (1, "heavy"), (3, "alpha")], "atom_id int, kind string")
    got = S.select_atoms(df, topology, "alpha").orderBy("frame_no").collect()
    assert np.allclose([r.coords for r in got], xyz[:, [0, 3]])
    assert S.select_atoms(df, topology, "none").first().coords == []


def test_labels_file(spark, tmp_path):
    (tmp_path / "labels.txt").write_text(" 0   2\n1\t3\n\n2 2.0 extra\n")
    got = S.read_labels(spark, str(tmp_path / "labels.txt")).orderBy("first").collect()
    assert [(r.first, r.label) for r in got] == [("0", 2.0), ("1", 3.0), ("2", 2.0)]


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_row_index(spark, buckets):
    keys = np.random.default_rng(1).permutation(1000)[:300] * 7 - 900
    df = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(5)
    got = S.with_row_index(df, "key", buckets=buckets).orderBy("key").collect()
    assert [r.idx for r in got] == list(range(300))


def test_window_labels(spark, frames):
    _, df = frames
    marked = df.withColumn("state", F.col("frame_no") * 2)
    labels = L.midpoint_labels(marked, "state", 10)
    assert sorted(labels.collect()) == [(0, 10), (1, 30), (2, 50), (3, 70)]
    got = {r.frame_no: r.label for r in L.expand_window_labels(df, labels, 10).collect()}
    assert got == {i: (i // 10) * 20 + 10 for i in range(40)}


def test_slices_and_splits(frames):
    _, df = frames
    assert sorted(r.frame_no for r in L.slice_per_trajectory(df, 2, 5, 20).collect()) == [2, 3, 4, 22, 23, 24]
    for method in ("hash", "modulo", "random"):
        train, test = L.train_test_split(df, 0.7, "frame_no", method=method, seed=3)
        ids = [sorted(r.frame_no for r in part.collect()) for part in (train, test)]
        assert sorted(ids[0] + ids[1]) == list(range(40)) and ids[0] and not set(ids[0]) & set(ids[1])
    again = L.train_test_split(df.repartition(7), 0.7, "frame_no", seed=3)[0]
    assert sorted(r.frame_no for r in again.collect()) == sorted(r.frame_no for r in L.train_test_split(df, 0.7, "frame_no", seed=3)[0].collect())
    with pytest.raises(ValueError):
        L.train_test_split(df, 1.5, "frame_no")


def test_superpose_undoes_rigid_motion(spark):
    rng = np.random.default_rng(2)
    ref = rng.normal(size=(7, 3))
    rows = []
    for i in range(20):
        q, r = np.linalg.qr(rng.normal(size=(3, 3)))
        q = q * np.sign(np.diag(r))
        q[:, 0] *= np.linalg.det(q)
        rows.append((i, (ref @ q + rng.normal(size=3)).tolist()))
    rows.append((99, (ref * [1, 1, -1]).tolist()))
    df = spark.createDataFrame(rows, "frame_no long, coords array<array<double>>")
    got = {r.frame_no: np.array(r.coords) for r in L.superpose(df, ref).collect()}
    assert all(np.allclose(got[i], ref) for i in range(20))
    assert not np.allclose(got[99], ref)
    own = lambda a: np.linalg.norm(a[:, None] - a[None], axis=-1)
    assert np.allclose(own(got[99]), own(ref))


def test_atom_distances(frames):
    xyz, df = frames
    got = L.pairwise_atom_distances(df, [4, 0, 2]).orderBy("frame_no").collect()
    expected = np.linalg.norm(xyz[:, [0, 0, 2]] - xyz[:, [2, 4, 4]], axis=2)
    assert np.allclose([r.x for r in got], expected)
    assert neighbours.knn_join(L.pairwise_atom_distances(df, [0, 1]), L.pairwise_atom_distances(df, [0, 1]), 1,
                               query_id="frame_no", data_id="frame_no").count() == 40
