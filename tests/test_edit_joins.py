import random

import pytest

from manyscale.operators import edit_joins as E


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def words(seed, n=90):
    pick = random.Random(seed)
    return [(k, "".join(pick.choice("abé") for _ in range(pick.randint(0, 11)))) for k in range(n)]


@pytest.mark.parametrize("r", [0, 1, 2, 4])
def test_close_pairs_and_membership(spark, r):
    rows = [*words(r), (500, None), (501, "abab"), (502, "abab"), (503, "ab" * 40), (504, "ab" * 39 + "b")]
    pairs, members = E.edit_close_pairs(spark.createDataFrame(rows, "point_id long, x string").repartition(3), r)
    first = {}
    for k, x in rows:
        first.setdefault(x, k)
    assert sorted(members.collect()) == [(k, first[x]) for k, x in rows if x is not None]
    names = [(k, x) for x, k in first.items() if x is not None]
    want = sorted((i, j, float(d)) for i, x in names for j, y in names if i < j and (d := edits(x, y)) <= r)
    assert sorted(tuple(p) for p in pairs.collect()) == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not any(part in plan for part in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_range_join(spark):
    a, b = words(5), words(6)
    table = lambda rows: spark.createDataFrame(rows, "point_id long, x string")
    left, right = ({x: k for k, x in reversed(rows)} for rows in (a, b))
    want = sorted((i, j, float(d)) for x, i in left.items() for y, j in right.items() if (d := edits(x, y)) <= 2)
    assert sorted(tuple(p) for p in E.edit_range_join(table(a), table(b), 2).collect()) == want
    with pytest.raises(ValueError):
        E.edit_close_pairs(table(a), 1.5)


def test_pair_counts(spark):
    from manyscale.operators import neighbours

    a, b = [*words(7), (90, "ab"), (91, "ab"), (92, None)], words(8, 40)
    table = lambda rows: spark.createDataFrame(rows, "point_id long, x string").repartition(3)
    left = table(a)
    for other, rows in ((left, a), (table(b), b)):
        d = [edits(x, y) for _, x in a if x is not None for _, y in rows if y is not None]
        got = [(r.radius, r.n_pairs) for r in neighbours.count_pairs(left, other, [0.0, 2.5, 2.0, 4.0, 2.0], metric="levenshtein").collect()]
        assert sorted(got) == sorted((r, sum(x <= r for x in d)) for r in [0.0, 2.5, 2.0, 4.0, 2.0])
