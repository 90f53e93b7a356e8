"""Registered queries against their SQL, and the shape of the driver contract."""

import pytest

import __spark_entry__ as contract
import check

SF = "/root/testdata/sf0.001"
# One or two per module; check.py runs them all.
CHECKED = ["flatten_frames", "matrix_multiply", "pca_spectrum", "truncated_svd", "affine_reconstruct", "fit_tree", "representations", "prune_cells",
           "project_points", "multiscale_features", "wavelets", "knn_join", "range_join_pruned", "count_pairs_pruned",
           "metric_partitions", "expand_window_labels", "superpose", "classify_split", "reconstruct"]


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, con, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert len(got) and check.difference(got, check.answer(con, contract.oracle_sql()[name])) == ""


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 500


def test_no_all_pairs_plan(spark):
    for name in ("knn_join", "range_join", "close_pairs", "distance_matrix", "matrix_multiply_blocks", "knn_classify"):
        plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
