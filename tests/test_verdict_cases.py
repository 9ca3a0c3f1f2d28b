"""Cases that once gave wrong or missing rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hemolens import session
from hemolens.functions import ordered
from hemolens.operators import aggregates, free_energy as fe, gates, models, splits, trajectory
from hemolens.sources import text


def test_effective_samples_take_as_many_lags_as_the_series_needs(spark):
    rng = np.random.default_rng(0)
    x = np.zeros(4000)
    for i in range(1, 4000):
        x[i] = 0.98 * x[i - 1] + rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": np.arange(4000), "z": x}))
    d = x - x.mean()
    g, t = 1.0, 1
    while t < 4000 and (rho := (d[:-t] * d[t:]).mean() / d.var()) > 0:
        g += 2 * (1 - t / 4000) * rho
        t += 1
    for fill in (4, 8, 16):
        got = fe.autocorr_neff(df, ["k"], ["t"], fill=fill).first()
        assert abs(got.g - g) < 1e-9 and got.n_eff < 100


def test_effective_samples_of_short_and_flat_series(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 3.0), (2, 1, 3.0), (2, 2, 3.0)], "k int, t int, z double")
    got = {r.k: (r.n, r.g) for r in fe.autocorr_neff(df, ["k"], ["t"]).collect()}
    assert got == {1: (1, 1.0), 2: (3, 1.0)}


def test_unconverged_profiles_say_so_and_fail_the_gate(spark):
    rows = [(0, b, n) for b, n in ((0, 5), (1, 9), (2, 4))] + [(1, b, n) for b, n in ((1, 3), (2, 8), (3, 6))]
    hist = spark.createDataFrame([(7, *r) for r in rows], "p int, window_id int, bin long, n long")
    wins = spark.createDataFrame([(0, 0.3, 5.0), (1, 0.5, 5.0)], "window_id int, z0 double, k double")
    assert {r.converged for r in fe.wham(hist, wins, ["p"], 0.2, max_iterations=1).collect()} == {False}
    assert {r.converged for r in fe.wham(hist, wins, ["p"], 0.2).collect()} == {True}
    checks = spark.createDataFrame([(0.5, 300.0, 1.0, 1.0, c) for c in (True, False, None)], "overlap double, n_eff double, half_diff double, rep_diff double, converged boolean")
    assert sorted(r.passed for r in gates.qc_gate(checks).collect()) == [False, False, True]


def test_resampled_profiles_spread_around_the_profile(spark):
    rng = np.random.default_rng(3)
    rows = [(1, w, t, float(rng.normal(0.4 * w, 0.35))) for w in range(4) for t in range(400)]
    samples = spark.createDataFrame(rows, "p int, window_id int, t int, z double")
    wins = spark.createDataFrame([(w, 0.4 * w, 15.0) for w in range(4)], "window_id int, z0 double, k double")
    again = fe.resampled_profiles(samples, wins, ["p"], ["t"], 0.1, block=10, replicates=60, stack=25)
    assert again.select("resample").distinct().count() == 60 and again.filter("not converged").isEmpty()
    se = fe.feature_errors(fe.bulk_zero(again, ["p", "resample"], 1.2), ["p"], surface=(-0.4, 0.3), head=(0.5, 1.0)).first()
    assert se is None or se.resamples == 60
    whole = fe.wham(fe.window_histogram(samples, ["p", "window_id"], 0.1), wins, ["p"], 0.1)
    both = again.groupBy("z").agg(F.avg("g").alias("m"), F.stddev("g").alias("s")).join(whole, "z").filter("z between 0 and 1.2")
    gap = both.agg(F.stddev(F.col("m") - F.col("g")), F.avg("s")).first()
    assert gap[0] < 0.5 and 0 < gap[1] < 2


def test_sequences_with_ids_that_repeat_across_sources(spark):
    rows = [("P1", "AAA", "fasta"), ("P1", "AAA", "csv"), ("P2", "AAA", "csv"), ("P1", "CCC", "other")]
    out = aggregates.dedupe_sequences(spark.createDataFrame(rows, "peptide_id string, sequence string, source string"))
    got = {r.sequence: (r.peptide_id, r.copies, r.sources) for r in out.collect()}
    assert got == {"AAA": ("P1", 3, ["csv", "fasta"]), "CCC": ("P1", 1, ["other"])}
    assert len({r.seq_hash for r in out.collect()}) == 2


def test_thickness_with_several_peptides_in_a_frame(spark):
    cells = spark.createDataFrame([(1, 0, 0, 3.0), (1, 50, 0, 5.0), (1, 25, 0, 9.0), (2, 0, 0, 1.0)], "frame int, cx long, cy long, thickness double")
    peptides = spark.createDataFrame([(1, 0.05, 0.05), (1, 5.05, 0.05)], "frame int, x double, y double")
    got = trajectory.thickness_contrast(cells, peptides, ["frame"], 0.1, 0.15).collect()
    assert [tuple(r) for r in got] == [(1, 4.0, 9.0, -5.0)]


def test_attribution_of_a_row_is_the_same_in_any_batch(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 200))
    df = spark.createDataFrame(pd.DataFrame({"peptide_id": range(200), "a": a, "b": b, "y": (a + rng.normal(0, 0.5, 200) > 0).astype(int), "hc50_um": 5.0}))
    model = models.fit_logistic(df, ["a", "b"])
    whole = models.score_batch(model, df, ["a", "b"], explain=True).filter("peptide_id = 3").first()
    alone = models.score_batch(model, df.filter("peptide_id = 3"), ["a", "b"], explain=True).first()
    assert whole.contrib_a == alone.contrib_a != 0


def test_no_machine_local_scratch_beyond_one_machine(spark, monkeypatch):
    with pytest.raises(ValueError, match="share"):
        session.build_session("spark://nowhere:7077")
    assert session.on_one_machine("local[8]") and session.on_one_machine("local")
    assert not session.on_one_machine("local-cluster[2,1,1024]") and not session.on_one_machine("yarn")


def test_label_files_with_another_column_order(spark, tmp_path):
    (tmp_path / "l.csv").write_text('NAME,sequence_length,HC50_uM,SEQUENCE,PROJECT_ID\n"A, b",3,7.5,KLK,PEP_9\n')
    assert tuple(text.scan_labels(spark, str(tmp_path / "l.csv")).first()) == ("PEP_9", "KLK", 7.5, 3, "A, b")


def test_label_folders_with_several_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("X_ID,SEQUENCE,HC50_uM,sequence_length,NAME\nP1,KK,1.5,2,one\nP2,RR,250,2,two\n")
    (tmp_path / "b.csv").write_text("name,hc50_um,amp_id,sequence,sequence_length\nthree,9,P3,LL,2\n")
    (tmp_path / "c.csv").write_text("X_ID,SEQUENCE,HC50_uM,sequence_length,NAME\nP4,,,,\n")
    rows = sorted(tuple(r) for r in text.scan_labels(spark, str(tmp_path)).collect())
    assert rows == [("P1", "KK", 1.5, 2, "one"), ("P2", "RR", 250.0, 2, "two"), ("P3", "LL", 9.0, 2, "three"), ("P4", None, None, None, None)]


def test_label_headers_in_doubt_fail(spark, tmp_path):
    (tmp_path / "l.csv").write_text("ID,SEQUENCE,sequence_length,NAME\nP1,K,1,x\n")
    with pytest.raises(ValueError, match="hc50_um"):
        text.scan_labels(spark, str(tmp_path / "l.csv"))
    (tmp_path / "m.csv").write_text("amp_id,batch,SEQUENCE,HC50_UM,sequence_length,NAME\nP1,7,K,2,1,x\n")
    with pytest.raises(ValueError, match="one id column"):
        text.scan_labels(spark, str(tmp_path / "m.csv"))
    assert tuple(text.scan_labels(spark, str(tmp_path / "m.csv"), "AMP_ID").first()) == ("P1", "K", 2.0, 1, "x")
    (tmp_path / "none.csv").write_text("")
    assert text.scan_labels(spark, str(tmp_path / "none.csv")).count() == 0


def test_null_keys_and_values_keep_their_rows(spark):
    rows = [(1, "a", 2.0), (2, None, 1.0), (3, None, 3.0), (4, "a", None), (5, "b", 2.0)]
    df = spark.createDataFrame(rows, "i int, k string, v double")
    ranked = ordered.average_rank(df, "v", ["k"])
    assert ranked.count() == 5
    run = ordered.row_numbers(ordered.with_order_bucket(df, "i", 3), ["k"], ["i"]).collect()
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("i"))).collect()
    assert {(r.i, r.rn) for r in run} == {(r.i, r.rn) for r in plain}
    filled = ordered.fill_forward(ordered.with_order_bucket(df, "i", 3), ["k"], ["i"], "v", "f").collect()
    assert {(r.i, r.f) for r in filled} == {(1, 2.0), (2, 1.0), (3, 3.0), (4, 2.0), (5, 2.0)}
    split = splits.stratified_split(df, "k", "i")
    assert split.count() == 5


def test_tied_values_are_spread_over_buckets(spark):
    df = spark.range(20_000).select(F.col("id").alias("peptide_id"), F.when(F.col("id") % 10 < 9, 250.0).otherwise(F.col("id") / 7.0).alias("hc50_um"))
    bucketed = ordered.with_order_bucket(df, "hc50_um", 8, tie="peptide_id")
    assert bucketed.groupBy(ordered.BUCKET).count().agg(F.max("count")).first()[0] < 6_000
    got = {(r.peptide_id, r.rn) for r in ordered.row_numbers(bucketed, [], ["hc50_um", "peptide_id"]).collect()}
    rows = sorted(((r.hc50_um, r.peptide_id) for r in df.collect()))
    assert got == {(i, k) for k, (_, i) in enumerate(rows, 1)}
