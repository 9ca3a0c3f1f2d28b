"""Nearest neighbours of vectors and SMOTE against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemolens.operators import nearest, splits


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids if ids is not None else range(len(x)), x)], "atom_id long, x array<double>")


def plain(x, ids, k):
    """{id: [(distance, id), ...]} over distinct vectors."""
    least = {}
    for i, row in zip(ids, map(tuple, x)):
        least[row] = min(i, least.get(row, i))
    rows = sorted((i, row) for row, i in least.items())
    p = np.array([r for _, r in rows])
    out = {}
    for n, (i, row) in enumerate(rows):
        d = np.sqrt(((p - np.array(row)) ** 2).sum(1))
        out[i] = sorted((round(float(v), 9), j) for m, (v, (j, _)) in enumerate(zip(d, rows)) if m != n)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("a_id", "place").collect():
        out.setdefault(r.a_id, []).append((round(r.dist, 9), r.b_id))
    return out


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_two_thousand_points_in_all_dimensions(spark, spread):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 64))[rng.integers(0, 30, 2000)] + spread * rng.normal(size=(2000, 64))
    got = nearest.nearest_neighbours(table(spark, x), 5, pivots=40, block=50)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert found(got) == plain(x, range(2000), 5)


def test_equal_points_ties_and_one_hot_cell(spark):
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 4, size=(500, 3)).astype(float)  # many copies, many ties
    hot = np.concatenate([grid, 1e-3 * rng.normal(size=(600, 3))])
    ids = rng.permutation(5000)[: len(hot)]
    got = nearest.nearest_neighbours(table(spark, hot, ids), 4, pivots=8, block=16)
    assert found(got) == plain(hot, [int(i) for i in ids], 4)


def test_points_that_are_bounded_by_their_own_ring_visit_few_others(spark):
    rng = np.random.default_rng(3)
    centre = 100 * rng.normal(size=(20, 16))
    x = centre[np.repeat(np.arange(20), 60)] + 0.01 * rng.normal(size=(1200, 16))
    points = table(spark, x)
    kind, pivots = "bigint", centre + 0.001
    blocks = nearest._blocks(nearest._in_cells(points, "atom_id", pivots), 100).cache()
    inside = nearest._inside_blocks(blocks, kind, 5)
    assert nearest.open_visits(inside, blocks, pivots, 5).count() == 0


def test_small_and_odd_inputs(spark):
    schema = "atom_id long, x array<double>"
    none = spark.createDataFrame([], schema)
    assert nearest.nearest_neighbours(none, 3).count() == 0 and splits.smote(none, 3, 2).count() == 0
    odd = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [3.0, 3.0])], schema)
    assert nearest.nearest_neighbours(odd, 3).count() == 0
    three = table(spark, [[0.0], [1.0], [3.0]])
    assert found(nearest.nearest_neighbours(three, 9)) == {0: [(1.0, 1), (3.0, 2)], 1: [(1.0, 0), (2.0, 2)], 2: [(2.0, 1), (3.0, 0)]}


def test_synthetic_points_lie_between_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 10))
    made = splits.smote(table(spark, x), 4, 3).collect()
    near = plain(x, range(60), 4)
    assert len(made) == 180
    for r in made:
        assert r.b_id in {j for _, j in near[r.a_id]}
        a, b, y = x[r.a_id], x[r.b_id], np.array(r.x)
        u = (y - a) @ (b - a) / ((b - a) @ (b - a))
        assert 0 <= u < 1 and np.allclose(y, a + u * (b - a))


def test_null_ids_are_left_out(spark):
    df = table(spark, [[0.0], [1.0]]).withColumn("atom_id", F.when(F.col("atom_id") > 0, F.col("atom_id")))
    assert nearest.nearest_neighbours(df, 1).count() == 0
