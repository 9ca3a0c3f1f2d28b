"""Plans that must hold at any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hemolens.operators import free_energy as fe
from hemolens.operators import joins, layout
from hemolens.plans import gates
from hemolens.plans.binding import Tables


def test_exploded_positions_are_not_broadcast(spark):
    template = spark.createDataFrame(pd.DataFrame({"mol": [0, 0, 1], "x": [0.0, 2.0, 1.0], "y": [1.0, 1.0, 0.0], "z": [0.0, 0.0, 0.0]}))
    systems = spark.createDataFrame([(0, 4, 10.0, 10.0), (1, 1, 10.0, 10.0)], "mol long, n int, lx double, ly double")
    positions = layout.grid_positions(systems).select("mol", "k", F.col("x").alias("px"), F.col("y").alias("py"))
    placed = joins.place_atoms(template.withColumn("tilt", F.lit(0)), positions, "tilt", 8.5, 3.0, "mol")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [mol" in plan and "BroadcastHashJoin [mol" not in plan
    assert placed.count() == 9


def test_a_run_on_its_limit_does_not_turn_on_the_order_of_a_sum(spark, tmp_path):
    rng = np.random.default_rng(0)
    cents = rng.integers(0, 10_000, 59)
    values = [float(c) / 100 for c in [*cents, 300_000 - cents.sum()]]  # a mean of 50 is an overlap of 0.1
    orders = [list(rng.permutation(values)) for _ in range(200)]
    orders.sort(key=lambda o: float(sum_in_turn(o)))
    assert sum_in_turn(orders[-1]) > 3000.0
    rows = [(int(run * 100 + i), run, float(v)) for run, o in enumerate((orders[0], orders[-1])) for i, v in enumerate(o)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = gates.qc_gate(Tables(spark, str(tmp_path))).collect()
    assert len(found) == 2 and all("overlap" in r.failed and not r.passed for r in found)


def sum_in_turn(values):
    total = 0.0
    for v in values:
        total += float(v)
    return total


def test_darts_are_thrown_once_for_systems_that_are_alike(spark, monkeypatch):
    rows = [(s, 7 + s % 2, 5, 10.0, 10.0, "random") for s in range(400)]
    df = spark.createDataFrame(rows, "system long, seed long, n int, lx double, ly double, orientation string")
    thrown = []
    monkeypatch.setattr(layout, "cut_lineage", lambda d: thrown.append(d.count()) or d)
    placed = layout.poisson_positions(df)
    assert thrown == [2] and placed.count() == 2000
    for seed in (7, 8):
        darts, last = layout._throw_darts(seed, 5, 10.0, 10.0, 1.5, 10_000)
        for system in (seed - 7, seed + 193):
            got = placed.filter(F.col("system") == system).orderBy("k").collect()
            assert [(r.x, r.y) for r in got] == [tuple(d) for d in darts] and {r.tilt for r in got} == {layout._tilt_after(seed, last)}


def test_resampled_profiles_are_the_same_in_units_and_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"peptide_id": np.arange(600) % 2, "window_id": np.arange(600) // 2 % 3, "t": np.arange(600), "z": rng.normal(size=600) * 0.3})
    windows = spark.createDataFrame([(w, 0.2 * w - 0.2, 20.0) for w in range(3)], "window_id long, z0 double, k double")
    found = []
    for whole in (1 << 22, 1):
        monkeypatch.setattr(fe.units, "WHOLE", whole)
        out = fe.resampled_profiles(spark.createDataFrame(rows), windows, ["peptide_id"], ["t"], 0.2, 5, replicates=12)
        found.append(out.orderBy("peptide_id", "resample", "z").toPandas())
    assert len(found[0]) > 50 and np.allclose(found[0].astype(float), found[1].astype(float), atol=1e-9)


def test_block_means_are_the_same_in_units_and_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame(pd.DataFrame({"k": np.arange(300) % 3, "t": np.arange(300), "z": rng.normal(size=300)}))
    found = []
    for whole in (1 << 22, 1):
        monkeypatch.setattr(fe.units, "WHOLE", whole)
        found.append(fe.block_bootstrap(rows, ["k"], ["t"], 5, 40).orderBy("k").toPandas())
    assert np.allclose(found[0], found[1])
