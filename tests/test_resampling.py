"""Resampled rank statistics and their jackknife against direct computation."""

import hashlib
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hemolens.functions import digests, draws
from hemolens.operators import resampling as rs


def ranks(v):
    return pd.Series(v).rank().to_numpy()


def rho(x, y):
    a, b = ranks(x) - (len(x) + 1) / 2, ranks(y) - (len(y) + 1) / 2
    down = np.sqrt((a * a).sum() * (b * b).sum())
    return (a * b).sum() / down if down > 0 else np.nan


def auc(y, p):
    pos, neg = p[y == 1], p[y != 1]
    return ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean() if len(pos) and len(neg) else np.nan


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 90
    x = rng.integers(0, 25, n).astype(float)
    return pd.DataFrame({"i": np.arange(n) * 3, "x": x, "v": np.round(x / 9 + rng.normal(size=n), 1), "y": (x + 6 * rng.normal(size=n) > 12).astype(int)})


@pytest.mark.parametrize("stat, a, b, plain", [("auc", "y", "v", auc), ("spearman", "x", "v", rho)])
def test_bca_equals_direct_computation(spark, frame, stat, a, b, plain):
    reps = 400
    df = spark.createDataFrame(frame).repartition(3)
    items = rs.numbered(df, "i", {"a": a, "b": b}, "boot").toPandas().sort_values("item")
    one, two = items.a.to_numpy(), items.b.to_numpy()
    slots = spark.range(1, reps + 1).select(F.col("id").alias("rep")).crossJoin(spark.range(len(items)).select(F.col("id").alias("slot")))
    drawn = slots.select("rep", "slot", draws.draw_index(len(items), F.lit("boot"), "rep", "slot").alias("item")).toPandas()
    stats = np.array([plain(one[g], two[g]) for g in (part.item.to_numpy() for _, part in drawn.groupby("rep"))])
    names, replicate, jackknife = rs.STATISTICS[stat]
    got = replicate(rs.numbered(df, "i", dict(zip(names, (a, b))), "boot"), reps, "boot").toPandas().sort_values("rep")
    assert np.allclose(got.stat, stats, atol=1e-10)
    keep = np.arange(len(one))
    left = np.array([plain(one[keep != k], two[keep != k]) for k in keep])
    dev = left.mean() - left
    accel = (dev**3).sum() / (6 * (dev**2).sum() ** 1.5)
    observed, found = jackknife(rs.numbered(df, "i", dict(zip(names, (a, b))), "boot"))
    assert abs(observed.first().stat - plain(one, two)) < 1e-12 and abs(found.first().a - accel) < 1e-9
    norm = NormalDist()
    z0 = norm.inv_cdf((stats < plain(one, two) - 1e-12).mean())
    levels = [norm.cdf(z0 + (z0 + z) / (1 - accel * (z0 + z))) for z in (norm.inv_cdf(0.025), norm.inv_cdf(0.975))]
    out = rs.bootstrap_rank_ci(df, "i", a, b, stat, reps).first()
    assert out.resamples == reps and np.allclose([out.ci_low, out.ci_high], np.quantile(stats, levels), atol=1e-9)
    plain_ends = rs.bootstrap_rank_ci(df, "i", a, b, stat, reps, method="percentile").first()
    assert np.allclose([plain_ends.ci_low, plain_ends.ci_high], np.quantile(stats, [0.025, 0.975]), atol=1e-9)


def test_counts_of_items_above_in_both(spark):
    rng = np.random.default_rng(1)
    n = 300
    pos, y = rng.integers(0, 40, n), rng.integers(0, 12, n)
    df = spark.createDataFrame(pd.DataFrame({"item": np.arange(n), "pos": pos, "y": y.astype(float), "_b_y": y // 4}))
    half = lambda d: (d > 0) + 0.5 * (d == 0)
    want = (half(pos[None] - pos[:, None]) * half(y[None] - y[:, None])).sum(1)
    got = rs.exceeded(df, n).toPandas().sort_values("item").both.to_numpy()
    assert np.allclose(got, want)


def test_replicates_are_not_shuffled_to_be_counted(spark):
    plan = rs.multiplicities(100, 50, spark, "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort" not in plan


def test_degenerate_inputs(spark):
    schema = "i long, a double, b double"
    assert tuple(rs.bootstrap_rank_ci(spark.createDataFrame([], schema), "i", "a", "b").first())[:2] == (None, 0)
    flat = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 3.0), (3, None, 1.0), (4, 1.0, None)], schema)
    for stat in ("auc", "spearman"):
        row = rs.bootstrap_rank_ci(flat, "i", "a", "b", stat, 20).first()
        assert row.observed is None and row.resamples == 0 and row.ci_low is None


@pytest.mark.parametrize("stat, a, b", [("auc", "y", "v"), ("spearman", "x", "v")])
def test_units_equal_the_plan_over_rows(spark, frame, monkeypatch, stat, a, b):
    names, replicate, _ = rs.STATISTICS[stat]
    items = rs.numbered(spark.createDataFrame(frame), "i", dict(zip(names, (a, b))), "boot")
    got = replicate(items, 60, "boot")
    assert "InArrow" in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rs.units, "WHOLE", 10)
    want = replicate(items, 60, "boot").toPandas().sort_values("rep")
    assert np.allclose(got.toPandas().sort_values("rep").stat, want.stat, atol=1e-12)


def test_digests_equal_hashlib():
    prefixes = [b"s|%d|" % r for r in (1, 9, 10, 123456)] + [b"x" * 50, b"", b"s|2|"]
    texts = [str(i) for i in (0, 7, 10, 99, 100, 12345)] + ["", "é|ß", "y" * 60]
    suffixes = digests.by_length([t.encode() for t in texts])
    seen = 0
    for at, words in digests.matrices(prefixes, suffixes, 4):
        for i, row in zip(at, np.stack(words, axis=-1)):
            for text, four in zip(texts, row):
                assert "".join(f"{w:08x}" for w in four) == hashlib.md5(prefixes[i] + text.encode()).hexdigest()
                seen += 1
    assert seen == len(prefixes) * len(texts)
    assert [bytes(r).decode() for _, rows in digests.numbers(0, 1001) for r in rows] == [str(i) for i in range(1001)]
