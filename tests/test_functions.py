import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hemolens.functions import draws, geometry, ordered, scalars, sequence


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_label_bands_and_flags(spark):
    df = spark.createDataFrame([(50.0,), (249.9912112464796,), (250.0,), (100.0,), (9.9,), (None,)], "h double")
    got = df.select(scalars.hc50_band(F.col("h")), scalars.is_toxic(F.col("h")), scalars.flag_high_toxicity(F.col("h"))).collect()
    assert [r[0] for r in got] == ["toxic", "borderline", "nontoxic", "borderline", "toxic", None]
    assert [r[1] for r in got] == [1, 0, 0, 1, 1, None]
    assert [r[2] for r in got] == [False, False, False, False, True, None]


def test_names_steps_seeds(spark):
    r = one(
        spark,
        name=scalars.run_name(F.lit("PEP_1"), F.lit(3)),
        bad=scalars.parse_run_name(F.lit("a_run_x")),
        good=scalars.parse_run_name(F.lit("a_run_7")),
        steps=scalars.n_steps_ns(F.lit(400.0), F.lit(0.02)),
        every=scalars.n_steps(F.lit(100.0), F.lit(0.02)),
        seed=scalars.placement_seed(F.lit("PEP_1"), F.lit(8), F.lit("low"), F.lit(1)),
        crit=scalars.rbc_critical(F.lit(-8.0), F.lit(-3.0), F.lit(20.0)),
        crit2=scalars.rbc_critical(F.lit(-8.1), F.lit(0.0), F.lit(11.9)),
        umb=scalars.umbrella_seed(F.lit("PEP_1"), F.lit(2), F.lit(5)),
        tag=scalars.replicate_tag(scalars.occupancy_label(F.lit("low"), F.lit(5)), F.lit(2), 3),
    )
    assert r.name == "pep_1_run_3" and r.bad is None and r.good == 7
    assert (r.steps, r.every) == (20_000_000, 5_000)
    assert r.seed == zlib.crc32(b"PEP_1|8|low|rep1") and r.umb == zlib.crc32(b"PEP_1_rep2_umbrella5")
    assert r.crit is False and r.crit2 is True and r.tag == "n5_rep2"


def test_sequence_descriptors(spark):
    seq = "ALWKTLLKKVLKAAAK"
    r = one(
        spark,
        q=sequence.net_charge_ph(F.lit(seq)), g=sequence.gravy(F.lit(seq)), m=sequence.hydrophobic_moment(F.lit(seq)),
        ok=sequence.is_canonical(F.lit(seq)), bad=sequence.is_canonical(F.lit("AXB")), mapped=sequence.map_residues(F.lit(" abz "), {"B": "N"}),
        **{n: c for n, c in sequence.residue_fractions(F.lit(seq)).items()},
    )
    assert r.frac_K == 5 / 16 and abs(sum(r[f"frac_{a}"] for a in sequence.RESIDUES) - 1) < 1e-12
    assert abs(r.q - (1 + 5 / (1 + 10 ** (7 - 10.53)))) < 1e-9
    assert abs(r.g - np.mean([sequence.KYTE_DOOLITTLE[a] for a in seq])) < 1e-9
    h = np.array([sequence.EISENBERG[a] for a in seq])
    angle = np.radians(100) * np.arange(len(seq))
    assert abs(r.m - math.hypot((h * np.cos(angle)).sum(), (h * np.sin(angle)).sum()) / len(seq)) < 1e-9
    assert r.ok and not r.bad and r.mapped == "AN"


@pytest.mark.parametrize("axis", ["x", "y", "z", "?"])
def test_rotation_keeps_norms(spark, axis):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (-1.0, 0.5, 0.0)], "x double, y double, z double")
    for r in geometry.rotate(df, 37.0, axis).join(df.select(F.lit(1)), F.lit(True)).limit(2).collect():
        assert abs(math.sqrt(r.x**2 + r.y**2 + r.z**2) - math.sqrt(14)) < 1e-9 or abs(math.sqrt(r.x**2 + r.y**2 + r.z**2) - math.sqrt(1.25)) < 1e-9


def test_draws_are_uniform_and_repeat(spark):
    df = spark.range(20000).select(draws.draw_unit(F.lit("s"), "id").alias("u"), draws.draw_index(7, "id").alias("k"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.count_distinct("k"), F.max("k")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 <= r[1] and r[2] < 1 and r[3] == 7 and r[4] == 6
    assert df.agg(F.sum("u")).first() == df.agg(F.sum("u")).first()


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values repeat; some are null."""
    rng = np.random.default_rng(3)
    n = 5000
    return spark.createDataFrame(
        pd.DataFrame(
            {
                "k": np.where(rng.random(n) < 0.7, 0, rng.integers(1, 40, n)),
                "i": np.arange(n),
                "t": rng.permutation(n).astype(float),
                "v": rng.integers(0, 60, n).astype(float),
            }
        )
    ).withColumn("h", F.when(F.col("v") > 40, F.col("v")))


def same(a, b, *cols):
    assert sorted(map(tuple, a.select(*cols).collect()), key=str) == sorted(map(tuple, b.select(*cols).collect()), key=str)


def test_ordered_passes_equal_plain_windows(skewed):
    w = Window.partitionBy("k").orderBy("t")
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    b = ordered.with_order_bucket(skewed, "t", 16)
    same(ordered.running_total(b, ["k"], ["t"], {"s": "v"}), skewed.withColumn("s", F.sum("v").over(rows)), "i", "s")
    same(ordered.row_numbers(b, ["k"], ["t"]), skewed.withColumn("rn", F.row_number().over(w).cast("long")), "i", "rn")
    same(ordered.neighbour(b, ["k"], ["t"], {"p": "v"}), skewed.withColumn("p", F.lag("v").over(w)), "i", "p")
    same(ordered.neighbour(b, ["k"], ["t"], {"p": "v"}, following=True), skewed.withColumn("p", F.lead("v").over(w)), "i", "p")
    same(ordered.fill_forward(b, ["k"], ["t"], "h", "f"), skewed.withColumn("f", F.last("h", True).over(rows)), "i", "f")


def test_average_rank_equals_pandas(skewed):
    pdf = skewed.select("i", "k", "v").toPandas()
    pdf["want"] = pdf.groupby("k").v.rank()
    got = ordered.average_rank(skewed.select("i", "k", "v"), "v", ["k"]).toPandas().merge(pdf, on="i")
    assert (got.avg_rank == got.want).all() and len(got) == len(pdf)


def test_order_buckets_bound_the_hot_key(skewed):
    sizes = ordered.with_order_bucket(skewed, "t", 16).groupBy("k", "_bucket").count().agg(F.max("count")).first()[0]
    assert sizes < 5000 / 16 * 2


def test_negative_zero_is_zero_in_every_bucket(spark):
    values = [-0.0, 0.0] * 20 + [float(v) for v in range(-20, 0)] + [float(v) for v in range(1, 21)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    ranked = {r.i: r.avg_rank for r in ordered.average_rank(df, "v").collect()}
    assert len(ranked) == 80 and {ranked[i] for i in range(40)} == {40.5}
