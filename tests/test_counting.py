"""Contacts counted by blocks against the pairs themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemolens.operators import counting, neighbours


def beads(spark, seed, n, spread):
    r = np.random.default_rng(seed)
    rows = [(int(i), int(i % 2), *map(float, p), [None, "x", "y"][i % 3]) for i, p in enumerate(r.normal(0, spread, (n, 3)))]
    rows += [(n, None, 0.0, 0.0, 0.0, "x"), (n + 1, 0, float("nan"), 0.0, 0.0, "x"), (n + 2, 0, None, 0.0, 0.0, "x"), (None, 0, 0.0, 0.0, 0.0, "y")]
    return spark.createDataFrame(rows, "atom_id long, frame int, x double, y double, z double, kind string")


@pytest.mark.parametrize("box,cutoff,strict", [((0.7, 0.7, 0.7), 0.12, False), (None, 0.1, True), ((0.7, 0.5, 0.3), 0.2, False)])
def test_counts_are_those_of_the_pairs(spark, monkeypatch, box, cutoff, strict):
    monkeypatch.setattr(counting, "VISITORS", 40)
    monkeypatch.setattr(counting, "POINTS", 60)
    a, b = beads(spark, 1, 300, 0.15), beads(spark, 2, 700, 0.15)
    got = counting.count_contacts(a, b, cutoff, ["frame"], box=box, by="kind", strict=strict).collect()
    pairs = neighbours.contacts(a, b, cutoff, ["frame"], box=box, carry_b=["kind"], strict=strict)
    want = pairs.groupBy("frame", "a_id", F.col("b_kind").alias("kind")).agg(F.count("*"), F.min("dist")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and len(got) > 300


def test_points_on_a_grid_fall_on_the_right_side():
    at = np.random.default_rng(3).integers(0, 8, (3, 900)) / 8  # distances of just a quarter
    for strict in (False, True):
        n, nearest = counting.count_near(at[:, :200], at, 0.25, (1.0, 1.0, 1.0), strict)
        d = counting.distances(at[:, :200, None], at[:, None, :], (1.0, 1.0, 1.0))
        assert (n == (d < 0.25 if strict else d <= 0.25).sum(axis=1)).all() and (nearest == 0).all()


def test_dense_frames_form_no_pairs(spark):
    """30,000 x 30,000 beads in one cell: 900 million contacts, 30,000 rows."""
    point = [(F.rand(k) * 0.01).alias(a) for k, a in enumerate("xyz")]
    cloud = spark.range(30_000).select(F.col("id").alias("atom_id"), *point)
    got = counting.count_contacts(cloud, cloud, 0.12, box=(0.7, 0.7, 0.7)).agg(F.count("*"), F.min("n"), F.max("n"), F.max("nearest")).first()
    assert tuple(got) == (30_000, 30_000, 30_000, 0.0)
