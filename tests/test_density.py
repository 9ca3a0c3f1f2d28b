"""Density clusters against brute force, in frames too dense for their pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemolens.operators import trajectory


def brute(rows, eps, min_pts, box):
    out = {}
    for frame in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == frame]
        p = np.array([r[2:] for r in mine])
        d = p[:, None] - p[None]
        if box:
            d = d - np.array(box) * np.rint(d / np.array(box))
        near = np.sqrt((d * d).sum(axis=2)) <= eps
        core = near.sum(axis=1) >= min_pts
        label = {}
        for i in np.flatnonzero(core):  # ids rise with the place
            stack = [] if i in label else [i]
            while stack:
                j = stack.pop()
                if core[j] and j not in label:
                    label[j] = mine[i][0]
                    stack += np.flatnonzero(near[j]).tolist()
        for i in range(len(mine)):
            out[mine[i][0]] = label.get(i, min((label[j] for j in np.flatnonzero(near[i] & core)), default=None))
    return out


@pytest.mark.parametrize("eps,min_pts,box,few", [(0.1, 3, None, 0), (0.16, 5, (1.0, 1.0, 0.6), 4096), (0.4, 12, (1.0, 0.7, 0.6), 1), (0.05, 2, None, 2), (0.07, 1, None, 4096)])
def test_clusters_equal_brute_force(spark, monkeypatch, eps, min_pts, box, few):
    monkeypatch.setattr(trajectory, "FEW_PAIRS", few)
    r = np.random.default_rng(int(eps * 100))
    blobs = np.concatenate([r.normal(c, s, (n, 3)) for c, s, n in [(0, 0.05, 60), (0.3, 0.05, 60), (0.6, 0.02, 40), (0.5, 0.4, 60)]])
    rows = [(int(i), int(i % 2), *map(float, p)) for i, p in enumerate(blobs)]
    table = spark.createDataFrame([*rows, (999, 0, None, 0.0, 0.0)], "mol long, run int, x double, y double, z double").repartition(3)
    got = {x.id: x.cluster for x in trajectory.dbscan(table, ["run"], eps, min_pts, box=box).collect()}
    assert got == {**brute(rows, eps, min_pts, box), 999: None}


def test_two_dense_cells_beyond_reach_stay_apart(spark):
    """Two clouds of 4,000 points a little over eps apart: 8 million pairs within each, 16 million between them."""
    rows = spark.range(8001).select(F.col("id").alias("mol"), F.lit(0).alias("run"), F.when(F.col("id") < 4000, F.rand(1) * 0.01).when(F.col("id") < 8000, 1.06 + F.rand(2) * 0.01)
                                    .otherwise(0.535).alias("x"), (F.rand(3) * 0.01).alias("y"), (F.rand(4) * 0.01).alias("z"))
    got = trajectory.peptide_clusters(rows, ["run"], 1.0, 9000).first()
    assert (got.n_clusters, got.noise) == (0, 8001)
    got = trajectory.peptide_clusters(rows.filter("mol < 8000"), ["run"], 1.0, 3).first()
    assert (got.n_clusters, got.max_size, got.noise) == (2, 4000, 0)
