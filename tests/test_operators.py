import hashlib
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hemolens.operators import (
    aggregates, evaluation as ev, free_energy as fe, gates, joins, layout, models, neighbours, sets, splits, trajectory, windows,
)
from hemolens.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def cloud(spark):
    """Points with copies, points on cell borders, and a dense spot."""
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.uniform(0, 2, (250, 3)), rng.normal(1, 0.02, (60, 3)), np.round(rng.uniform(0, 2, (40, 3)), 1), np.tile([0.5, 0.5, 0.5], (5, 1))])
    return spark.createDataFrame(pd.DataFrame({"atom_id": np.arange(len(pts)), "frame": np.arange(len(pts)) % 2, "x": pts[:, 0], "y": pts[:, 1], "z": pts[:, 2]}))


def brute(pdf, cutoff, box=None, strict=False):
    p = pdf[["x", "y", "z"]].to_numpy()
    d = p[:, None] - p[None]
    if box is not None:
        d -= np.array(box) * np.rint(d / np.array(box))
    d = np.sqrt((d**2).sum(-1))
    hit = (d < cutoff if strict else d <= cutoff) & (pdf.frame.to_numpy()[:, None] == pdf.frame.to_numpy()[None])
    ids = pdf.atom_id.to_numpy()
    return {(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(hit)) if ids[i] < ids[j]}


@pytest.mark.parametrize("box", [None, (2.0, 2.0, 2.0), (0.7, 2.0, 2.0)])
@pytest.mark.parametrize("floor_rows", [5000, 3])
def test_close_pairs_equal_brute_force(cloud, box, floor_rows, monkeypatch):
    """A floor of 3 rows makes many cells hot, so the sliced path is taken."""
    monkeypatch.setattr(neighbours, "FLOOR_ROWS", floor_rows)
    pairs = neighbours.close_pairs(cloud, 0.3, ["frame"], box=box)
    got = [(r.a_id, r.b_id) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(cloud.toPandas(), 0.3, box)
    assert "CartesianProduct" not in plan(pairs) and "BroadcastNestedLoopJoin" not in plan(pairs)


def test_contacts_and_spacing(cloud):
    even, odd = cloud.filter("atom_id % 3 = 0"), cloud.filter("atom_id % 3 <> 0")
    got = {tuple(sorted((r.a_id, r.b_id))) for r in neighbours.contacts(even, odd, 0.25, ["frame"]).collect()}
    assert got == {p for p in brute(cloud.toPandas(), 0.25) if (p[0] % 3 == 0) != (p[1] % 3 == 0)}
    strict = {(r.a_id, r.b_id) for r in neighbours.spacing_violations(cloud, 0.2, ["frame"]).collect()}
    assert strict == brute(cloud.toPandas(), 0.2, strict=True)


def test_dbscan_equals_brute_force(cloud):
    pdf = cloud.toPandas()
    eps, min_pts = 0.18, 4
    edges = brute(pdf, eps)
    near = {i: {i} for i in pdf.atom_id}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    core = {i for i in near if len(near[i]) >= min_pts}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if j in core and j not in label:
                label[j] = i
                stack += near[j]
    want = {i: label.get(i, min((label[j] for j in near[i] if j in core), default=None)) for i in near}
    got = {r.id: r.cluster for r in trajectory.dbscan(cloud, ["frame"], eps, min_pts, "atom_id").collect()}
    assert got == want


def test_joins(spark):
    feats = spark.createDataFrame([("a", 1, "f"), ("a", 2, "g"), ("b", 3, "h")], "amp_id string, v int, src string")
    labs = spark.createDataFrame([("a", 10.0, "l"), ("a", 20.0, "m"), ("z", 1.0, "n")], "amp_id string, HC50 double, src string")
    out = joins.join_labels(feats, labs)
    assert out.count() == 4 and set(out.columns) == {"amp_id", "v", "src_x", "HC50", "src_y"}
    best = spark.createDataFrame([("r", "1"), ("s", "9")], "run_name string, rank string")
    files = spark.createDataFrame(
        [("r", "p_unrelaxed_rank_12.pdb"), ("r", "p_unrelaxed_rank_1_b.pdb"), ("r", "p_relaxed_rank_1.pdb"), ("s", "x_unrelaxed_rank_1.pdb")],
        "run_name string, file string",
    )
    assert joins.match_best_file(best, files).first().best_file == "p_unrelaxed_rank_12.pdb"
    assert joins.match_best_file(best, files, unmatched=True).first().run_name == "s"
    design = joins.expand_design(spark.range(4).withColumnRenamed("id", "peptide_id"), (1,), ("low", "high"), (1, 2, 3))
    assert design.count() == 24 and "Join" not in plan(design)
    assert joins.pending_work(design, design.filter("replicate = 2"), ["peptide_id", "occupancy", "replicate"]).count() == 16


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("a", 3.0, 1.0), ("a", 9.0, 0.0), ("b", 2.0, None)], "k string, value double, se double")
    pooled = aggregates.ivw_pool(df, ["k"]).collect()
    assert len(pooled) == 1 and abs(pooled[0].pooled - (4 * 1 + 1 * 3) / 5) < 1e-12 and pooled[0].pooled_se <= 0.5
    med = {r.k: r.median for r in aggregates.median_pool(df, ["k"]).collect()}
    assert med == {"a": 3.0, "b": 2.0}
    comp = spark.createDataFrame(
        [("m", k, n) for k, n in dict(CHOL=143, CL=78, NA=103, POPC=67, POPE=76, POPS=25, PSM=25, W=8260).items()], "file string, molecule string, n long"
    )
    ratios = aggregates.peptide_lipid_ratio(comp, {"low": 8, "medium": 12, "high": 16}).collect()
    assert sorted(r.ratio for r in ratios) == [21, 28, 42]
    pct = {r.molecule: r.pct for r in aggregates.pct_composition(comp).collect()}
    assert pct["W"] is None and abs(pct["CHOL"] - 100 * 143 / 336) < 1e-9
    plddt = spark.createDataFrame([([80.0, 90.0],), ([],), (None,)], "s array<double>")
    assert [r[0] for r in plddt.select(aggregates.mean_plddt("s")).collect()] == [85.0, 0.0, 0.0]
    top = aggregates.membrane_top(spark.createDataFrame([("s", "POPC", "PO4", 6.9)], "sys string, resname string, atom string, z double"), ["sys"], gates.is_head_bead())
    assert top.first().top_z == 8.5
    runs = spark.createDataFrame([("a", 1), ("a", None), ("a", 7), ("b", None)], "p string, n int")
    assert {r.p: r.next_run for r in aggregates.next_run_number(runs, ["p"], "n").collect()} == {"a": 8, "b": 1}
    dup = spark.createDataFrame([(2, "acd ", "x"), (1, "ACD", "y"), (3, "WWW", "x")], "peptide_id int, sequence string, source string")
    rows = {r.peptide_id: (r.copies, r.sources) for r in aggregates.dedupe_sequences(dup).collect()}
    assert rows == {1: (2, ["x", "y"]), 3: (1, ["x"])}
    assert sets.concat_features([runs, df]).columns == ["p", "n", "k", "value", "se"]


def test_gates(spark):
    best = spark.createDataFrame([(80.0,), (79.99,), (None,)], "best_plddt double")
    assert gates.gate_plddt(best).count() == 1 and gates.gate_plddt(best, rejected=True).count() == 2
    qc = spark.createDataFrame([(0.2, 200.0, 1.9, 2.0), (0.1, 199.0, 2.0, None)], "overlap double, n_eff double, half_diff double, rep_diff double")
    a, b = gates.qc_gate(qc).collect()
    assert a.passed and a.failed == [] and b.failed == ["overlap", "n_eff", "halves", "replicates"]


def test_layout_named_counts(spark):
    df = spark.createDataFrame([(n, 10.0, 10.0) for n in (1, 2, 8, 12, 16, 20)], "n int, lx double, ly double")
    got = {}
    for r in layout.grid_positions(df).orderBy("n", "k").collect():
        got.setdefault(r.n, []).append((round(r.x, 6), round(r.y, 6)))
    assert got[1] == [(5.0, 5.0)] and [p[1] for p in got[8]] == [2.5] * 3 + [5.0] * 2 + [7.5] * 3
    assert {p[1] for p in got[12]} == {2.0, 4.0, 6.0} and got[12][1] == (4.0, 2.0)
    assert got[16] == [(round(x, 6), round(y, 6)) for y in np.linspace(1.5, 8.5, 4) for x in np.linspace(1.5, 8.5, 4)]
    assert got[20] == [(round(x, 6), round(y, 6)) for y in np.linspace(1.5, 8.5, 5) for x in np.linspace(1.5, 8.5, 5)][:20]
    assert got[2] == [(1.5, 1.5), (8.5, 1.5)]


@pytest.mark.parametrize("n, lx, ly", [(1, 10, 10), (12, 10, 10), (16, 12, 9), (40, 6, 6)])
def test_darts_equal_one_by_one_throwing(n, lx, ly):
    rng, kept, left = np.random.default_rng(99), [], 10_000
    while len(kept) < n and left:
        left -= 1
        dart = (rng.uniform(1.5, max(1.5, lx - 1.5)), rng.uniform(1.5, max(1.5, ly - 1.5)))
        if all((dart[0] - p[0]) ** 2 + (dart[1] - p[1]) ** 2 >= 1.5**2 for p in kept):
            kept.append(dart)
    got, thrown = layout._throw_darts(99, n, lx, ly, 1.5, 10_000)
    assert (got is None) == (len(kept) < n) and thrown == 10_000 - left
    if got is not None:
        assert np.array_equal(got, np.array(kept))
    assert layout._tilt_after(99, thrown) == float(rng.choice([0.0, 45.0, 90.0]))


def test_tilts_come_from_the_generator_of_the_system(spark):
    rows = [(k, 5 + k % 30, 10.0, 9.0, 1000 + k, o) for k, o in enumerate(["random", None, "Parallel", "tilt_45", "90", "odd"] * 12)]
    df = spark.createDataFrame(rows, "system int, n int, lx double, ly double, seed long, orientation string")
    got = {r.system: r.tilt for r in layout.poisson_positions(df).collect()}
    for k, n, lx, ly, seed, o in rows:
        rng, kept = np.random.default_rng(seed), []
        for _ in range(10_000):
            if len(kept) == n:
                break
            dart = (rng.uniform(1.5, lx - 1.5), rng.uniform(1.5, ly - 1.5))
            if all((dart[0] - p[0]) ** 2 + (dart[1] - p[1]) ** 2 >= 2.25 for p in kept):
                kept.append(dart)
        drawn = float(rng.choice([0.0, 45.0, 90.0]))
        assert got[k] == {"Parallel": 0.0, "tilt_45": 45.0, "90": 90.0}.get(o, drawn)
    assert {got[k] for k, *_, o in rows if o == "odd"} == {0.0, 45.0, 90.0}
    tilt = layout.drawn_tilt(F.col("id"), F.lit(0)).alias("t")
    assert [r.t for r in spark.range(20).select("id", tilt).orderBy("id").collect()] == [float(np.random.default_rng(s).choice([0.0, 45.0, 90.0])) for s in range(20)]


def test_window_grid_golden(spark):
    rows = fe.window_grid(spark.range(1), F.lit(2.8), F.lit(-1.4)).orderBy("window_id").collect()
    assert len(rows) == 22 and abs(rows[0].z0 - 2.8) < 1e-9 and abs(rows[-1].z0 + 1.4) < 1e-9 and rows[0].k == 900


def test_wham_recovers_a_known_profile(spark):
    """Samples drawn exactly from windows on G = 4 z^2 with harmonic bias."""
    kt, k, bw = fe.thermal_energy(), 40.0, 0.05
    edges = np.arange(-30, 30)
    z = (edges + 0.5) * bw
    rows = []
    for w, z0 in enumerate(np.arange(-1.2, 1.21, 0.3)):
        p = np.exp(-(4 * z**2 + 0.5 * k * (z - z0) ** 2) / kt)
        rows += [(1, w, int(b), int(c)) for b, c in zip(edges, np.rint(p / p.sum() * 1_000_000)) if c > 0]
    hist = spark.createDataFrame(rows, "peptide_id int, window_id int, bin long, n long")
    wins = spark.createDataFrame([(w, float(z0), k) for w, z0 in enumerate(np.arange(-1.2, 1.21, 0.3))], "window_id int, z0 double, k double")
    out = fe.wham(hist, wins, ["peptide_id"], bw).toPandas()
    inside = out[out.z.abs() < 1.1]
    want = 4 * inside.z**2
    assert np.abs((inside.g - inside.g.min()) - (want - want.min())).max() < 0.05 and (out.residual < 1e-6).all()


def test_pchip_is_monotone_between_points(spark):
    pts = [(0.0, 0.0), (0.2, 1.0), (0.4, 1.0), (0.6, 5.0), (0.8, 2.0), (1.0, 2.5)]
    df = spark.createDataFrame([(1, z, g) for z, g in pts], "k int, z double, g double")
    out = fe.pchip_grid(df, ["k"], 0.01).orderBy("z").toPandas()
    assert len(out) == 101
    for (a, ga), (b, gb) in zip(pts, pts[1:]):
        part = out[(out.z >= a - 1e-9) & (out.z <= b + 1e-9)]
        assert part.g.min() >= min(ga, gb) - 1e-9 and part.g.max() <= max(ga, gb) + 1e-9
        assert abs(part.g.iloc[0] - ga) < 1e-9


def test_pmf_features_and_extension(spark):
    z = np.round(np.arange(-140, 281) * 0.01, 2)
    g = -9 * np.exp(-((z - 0.3) ** 2) / 0.02) - 12 * np.exp(-((z + 0.8) ** 2) / 0.05)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "z": z, "g": g}))
    r = fe.pmf_features(df, ["k"]).first()
    assert abs(r.z_surf_min - 0.3) < 0.011 and abs(r.z_head_min + 0.8) < 0.011
    assert abs(r.dg_ads + 9) < 0.01 and abs(r.dg_insert + 3) < 0.01 and abs(r.dg_barrier - 9) < 0.1
    qc = spark.createDataFrame(
        [(1, 1.0, 0.8, 20.0, 0.05, False), (2, 0.8, 0.6, 30.0, 0.05, False), (3, 0.6, 0.5, 30.0, 0.05, False), (4, 0.5, 0.3, 30.0, 0.4, True)],
        "window_id int, z0 double, next_z0 double, time_ns double, overlap double, passed boolean",
    )
    got = {r.window_id: (r.action, r.new_z0) for r in fe.extension_plan(qc).collect()}
    assert got[1] == ("extend", None) and got[2][0] == "insert" and abs(got[2][1] - 0.7) < 1e-9 and got[3][0] == "non-evaluable" and 4 not in got


@pytest.mark.parametrize("fill", [3, 6, 16])
def test_lagged_sums_are_those_of_the_series(spark, fill):
    rng = np.random.default_rng(3)
    series = {k: rng.normal(size=n) for k, n in enumerate((1, 2, 3, 64, 65, 1000))}
    rows = [(k, i, float(v), len(x)) for k, x in series.items() for i, v in enumerate(x, 1)]
    df = spark.createDataFrame(rows, "k int, idx long, _d double, n long").repartition(5)
    got = {}
    for r in fe.lagged_sums(df, ["k"], fill).collect():
        e2 = r._e - (r._e + 1) // 2
        got.setdefault(r.k, {}).update({r.t1 + (i << e2): v for i, v in enumerate(r.r)})
    for k, x in series.items():
        want = [float(x[: len(x) - t] @ x[t:]) for t in range(len(x))]
        assert np.allclose([got[k][t] for t in range(len(x))], want, atol=1e-9)


def test_one_plan_whatever_the_correlation_time(spark):
    t = np.arange(3000)
    slow = pd.DataFrame({"k": "slow", "t": t, "z": np.cos(t / 900)})
    fast = pd.DataFrame({"k": "fast", "t": t, "z": np.cos(t * 2.0)})
    jobs = []
    tracker = spark.sparkContext.statusTracker()
    for name, pdf in (("slow", slow), ("fast", fast)):
        df = spark.createDataFrame(pdf)
        spark.sparkContext.setJobGroup(f"neff-{name}", name)
        fe.autocorr_neff(df, ["k"], ["t"]).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"neff-{name}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    both = {r.k: r.g for r in fe.autocorr_neff(spark.createDataFrame(pd.concat([slow, fast])), ["k"], ["t"]).collect()}
    assert both["slow"] > 500 and both["fast"] == 1.0


def test_profiles_converge_in_tens_of_steps():
    rng = np.random.default_rng(11)
    centres, k, beta = np.linspace(-1.4, 2.6, 21), 300.0, 1 / fe.thermal_energy()
    grid = (np.arange(-80, 150) + 0.5) * 0.02
    energy = beta * 0.5 * k * (grid[:, None] - centres) ** 2
    weights = np.exp(-beta * 6 * np.sin(2 * grid))[:, None] * np.exp(-energy)
    counts = np.stack([[rng.multinomial(400, w / w.sum()) for w in weights.T] for _ in range(3)]).transpose(0, 2, 1).astype(float)
    counts[2] *= np.arange(21) < 19  # the last windows were never sampled
    keep = counts.sum(axis=(0, 2)) > 0
    counts, energy = counts[:, keep], energy[keep]
    log_p, f, rounds, residual = fe.solve_wham(counts, energy, np.zeros((3, 21)), 1e-10, 1000)
    assert residual.max() <= 1e-10 and rounds.max() <= 40
    for c, lp in zip(counts, log_p):
        n, slow = c.sum(0), np.where(c.sum(0) > 0, 0.0, -np.inf)
        used = n > 0
        for _ in range(60_000):  # the plain rounds
            p = c.sum(1) / (n[used] * np.exp(slow[used] - energy[:, used])).sum(1)
            fresh = -np.log((p[:, None] * np.exp(-energy[:, used])).sum(0))
            fresh -= fresh[0]
            gap = np.abs(fresh - slow[used]).max()
            slow[used] = fresh
            if gap < 1e-12:
                break
        there = c.sum(1) > 0
        a, b = lp[there], np.log(p[there])
        assert gap < 1e-11 and np.abs((a - a[0]) - (b - b[0])).max() < 1e-7


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    return spark.createDataFrame(pd.DataFrame({"peptide_id": np.arange(400), "y": y, "p": p, "fold": np.arange(400) % 5, "q": rng.integers(0, 9, 400)}))


def test_auc_properties(scored):
    auc = ev.roc_auc(scored).first().auc
    flipped = ev.roc_auc(scored.withColumn("p", 1 - F.col("p"))).first().auc
    assert abs(auc + flipped - 1) < 1e-9
    ci = ev.delong_ci(scored).first()
    assert abs(ci.auc - auc) < 1e-12 and ci.ci_low < auc < ci.ci_high
    assert abs(ev.roc_curve(scored).agg(F.max("tpr")).first()[0] - 1) < 1e-12
    assert ev.permutation_test(scored, "peptide_id", permutations=99).first().p_value == 0.01


@pytest.mark.parametrize("reach", [6.0, 0.01])  # the narrow band misses most permutations at first
def test_permutations_equal_brute_force(spark, reach):
    rng = np.random.default_rng(6)
    rows = [(f"i{k % 55}", int(rng.random() < 0.3), float(rng.normal())) for k in range(60)]  # five ids come twice
    got = ev.permutation_test(spark.createDataFrame(rows, "i string, y int, p double"), "i", permutations=200, reach=reach).first()
    p, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    m, gap = y.sum(), lambda s: s / y.sum() - (p.sum() - s) / (len(p) - y.sum())
    hits = 0
    for rep in range(1, 201):
        keys = sorted((hashlib.md5(f"perm|{rep}|{r[0]}".encode()).hexdigest(), r[0], r[2]) for r in rows)
        hits += abs(gap(sum(k[2] for k in keys[:m]))) >= abs(gap(p[y == 1].sum())) - 1e-12
    assert got.permutations == 200 and abs(got.p_value - (hits + 1) / 201) < 1e-12
    assert abs(got.observed - gap(p[y == 1].sum())) < 1e-12


def test_permutations_without_both_classes(spark):
    assert ev.permutation_test(spark.createDataFrame([], "i string, y int, p double"), "i", permutations=5).count() == 0
    assert ev.permutation_test(spark.createDataFrame([("a", 0, 1.0)], "i string, y int, p double"), "i", permutations=5).count() == 0


def test_kendall_and_wilcoxon_equal_brute_force(scored):
    pdf = scored.toPandas()
    i, j = np.triu_indices(len(pdf), 1)
    s = np.sign(pdf.p.to_numpy()[i] - pdf.p.to_numpy()[j]) * np.sign(pdf.q.to_numpy()[i] - pdf.q.to_numpy()[j])
    r = ev.kendall_tau(scored, "p", "q").first()
    assert (r.concordant, r.discordant) == ((s > 0).sum(), (s < 0).sum())
    assert abs(r.tau_b - pdf.p.corr(pdf.q, method="kendall")) < 1e-9 if _has_scipy() else True
    d = (pdf.p - 0.5).round(6)
    d = d[d != 0]
    got = ev.wilcoxon_signed_rank(scored.select(F.round(F.col("p") - 0.5, 6).alias("d0")), "d0").first()
    assert got.w_plus == d.abs().rank()[d > 0].sum() and got.n == len(d)


def _has_scipy():
    try:
        import scipy  # noqa: F401
    except ImportError:
        return False
    return True


def test_bca_equals_direct_computation(spark):
    values = np.random.default_rng(2).gamma(2.0, 1.0, 60)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(60), "v": values}))
    stats = np.sort([r.stat for r in ev.bootstrap_means(df, "i", "v", 300).collect()])
    jack = (values.sum() - values) / 59
    dev = jack.mean() - jack
    a = (dev**3).sum() / (6 * (dev**2).sum() ** 1.5)
    norm = NormalDist()
    z0 = norm.inv_cdf((stats < values.mean()).mean())
    levels = [norm.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (norm.inv_cdf(0.025), norm.inv_cdf(0.975))]
    want = np.quantile(stats, levels)
    got = ev.bootstrap_ci(df, "i", "v", 300, method="bca").first()
    assert abs(got.ci_low - want[0]) < 1e-9 and abs(got.ci_high - want[1]) < 1e-9


def test_splits_are_disjoint_exhaustive_and_stratified(scored):
    out = splits.stratified_split(scored, "y", "peptide_id").toPandas()
    assert len(out) == 400 and out.peptide_id.is_unique
    for _, part in out.groupby("y"):
        n = len(part)
        assert (part.split == "train").sum() == math.floor(0.7 * n + 0.5)
    folds = splits.stratified_folds(scored.drop("fold"), "y", "peptide_id", 5, inner=3).toPandas()
    assert folds.groupby(["y", "fold"]).size().groupby("y").agg(lambda s: s.max() - s.min()).max() <= 1
    again = splits.stratified_split(scored.repartition(7), "y", "peptide_id").toPandas()
    assert again.sort_values("peptide_id").split.tolist() == out.sort_values("peptide_id").split.tolist()
    bins = splits.hc50_bins(scored, 3, "p").groupBy("bin").count().toPandas()
    assert sorted(bins["count"]) == [133, 133, 134]


def test_models(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"peptide_id": np.arange(300), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "hc50_um": np.linspace(1, 300, 300)}))
    feats = ["a", "b", "c"]
    oof = models.fit_logistic_ridge(df, feats, "peptide_id", grid=(0.01, 1.0), outer=3, inner=2)
    assert oof.count() == 300 and ev.roc_auc(oof).first().auc > 0.95
    model = models.fit_logistic(df, feats)
    imp = {r.feature: r.importance for r in models.permutation_importance(model, df, feats, "peptide_id").collect()}
    assert imp["a"] > 0.3 and abs(imp["b"]) < 0.1
    out = models.score_batch(model, df, feats, explain=True)
    r = out.agg(F.avg("contrib_a"), F.sum(F.col("high_toxicity").cast("int")), F.corr("p", "contrib_a")).first()
    assert abs(r[0]) < 1e-9 and r[1] == 9 and r[2] > 0.8
    same = models.adversarial_validation(df.filter("peptide_id % 2 = 0"), df.filter("peptide_id % 2 = 1"), feats, "peptide_id").first().auc
    assert abs(same - 0.5) < 0.12
    pcs = models.pca(df, feats, 2).agg(F.corr("pc1", "pc2")).first()[0]
    assert abs(pcs) < 1e-6


def test_late_older_status_never_wins(spark, tmp_path):
    schema = "peptide_id string, ts timestamp, status string"
    src = str(tmp_path / "in")
    first = [("p", "2024-01-01 10:00:00", "completed"), ("q", "2024-01-01 09:00:00", "running")]
    late = [("p", "2024-01-01 08:00:00", "running"), ("q", "2024-01-01 11:00:00", "failed")]
    for n, rows in enumerate((first, late)):
        df = spark.createDataFrame(rows, "peptide_id string, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = jobs.drain(jobs.latest_status(stream, ["peptide_id"]), ["peptide_id"], "update")
    assert {r.peptide_id: r.status for r in out.collect()} == {"p": "completed", "q": "failed"}
    done = jobs.drain(jobs.progress_windows(stream, "ts", ["status"], "1 hour"), None, "complete")
    assert done.agg(F.sum("n")).first()[0] == 4


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS run_name", "id AS rank", "'m' AS model", "id % 17 AS mean_plddt")
    top = windows.top_models(df, 2)
    assert plan(top).count("WindowGroupLimit") >= 2 and top.count() == 6



def test_boosted_and_calibration(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    p = 1 / (1 + np.exp(-rng.normal(0, 2, 300)))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "t": x[:, 0] ** 2, "p": p}))
    model = models.fit_boosted(df, ["a", "b"], "y", depths=(3,), rates=(0.1,), trees=(8,))
    scored = model.transform(df).select("y", models.probability().alias("p"))
    assert ev.roc_auc(scored).first().auc > 0.9
    drawn = df.select("p").withColumn("y", (F.rand(7) < F.col("p")).cast("int"))
    line = models.calibration_line(drawn).first()
    assert 0.6 < line.slope < 1.5 and abs(line.intercept) < 0.6
