"""Splits, scores, intervals and tests (E01-E05, E08, E12-E24, E26)."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from hemolens.functions import draws
from hemolens.operators import evaluation as ev, resampling, splits
from hemolens.plans.binding import ASSAYS_SQL, PREDICTIONS_SQL, REPLICATES_SQL, draw_sql, r6, round6
from hemolens.plans.catalog import query
from hemolens.plans.windows import COUNTS_SQL

THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]


#: 1, 1/3, 1/15, ...: the odd double factorials below, for the series of the normal distribution.
_ODD = []
for _k in range(120):
    _ODD.append(1.0 if not _k else _ODD[-1] / (2 * _k + 1))


def phi_sql(z: str) -> str:
    """Normal distribution function by its series, good for |z| up to 8."""
    terms = f"list_sum(list_transform([{', '.join(f'{c!r}::DOUBLE' for c in _ODD)}], lambda c, k: c * pow({z}, 2 * k - 1)))"
    return f"(0.5 + exp(-({z}) * ({z}) / 2) / {math.sqrt(2 * math.pi)!r} * {terms})"


def bca_sql(replicates: int) -> str:
    """CTEs from `stats` (stat), `obs` (stat) and `acc` (a) to `ends` (boot_mean, ci_low, ci_high); the bias by bisection."""
    z = NormalDist().inv_cdf(0.975)
    level = lambda end: phi_sql(f"(z0 + (z0 + {end!r}) / (1 - a * (z0 + {end!r})))")
    at = lambda q: f"(s[lo_{q} + 1] + ({q} * (len(s) - 1) - lo_{q}) * (s[least(lo_{q} + 2, len(s))] - s[lo_{q} + 1]))"
    return f"""share AS (SELECT greatest(least(avg(CASE WHEN stats.stat < obs.stat - 1e-12 THEN 1.0 ELSE 0.0 END::DOUBLE), 1 - {0.5 / replicates!r}), {0.5 / replicates!r}) AS b
      FROM stats, obs WHERE stats.stat IS NOT NULL),
    bis AS (SELECT -6.0::DOUBLE AS lo, 6.0::DOUBLE AS hi, 0 AS n UNION ALL SELECT CASE WHEN f < b THEN mid ELSE lo END, CASE WHEN f < b THEN hi ELSE mid END, n + 1
      FROM (SELECT lo, hi, n, b, (lo + hi) / 2 AS mid, {phi_sql('((lo + hi) / 2)')} AS f FROM bis, share WHERE n < 50)),
    lv AS (SELECT {level(-z)} AS ql, {level(z)} AS qh FROM (SELECT (lo + hi) / 2 AS z0 FROM bis WHERE n = 50), acc),
    held AS (SELECT list_sort(list(stat)) AS s, avg(stat) AS boot_mean FROM stats WHERE stat IS NOT NULL),
    spot AS (SELECT *, CAST(floor(ql * (len(s) - 1)) AS INTEGER) AS lo_ql, CAST(floor(qh * (len(s) - 1)) AS INTEGER) AS lo_qh FROM held, lv),
    ends AS (SELECT len(s) AS resamples, boot_mean, {at('ql')} AS ci_low, {at('qh')} AS ci_high FROM spot)"""


ACC_SQL = "acc AS (SELECT sum(d * d * d) / (6 * pow(sum(d * d), 1.5)) AS a FROM (SELECT avg(t) OVER () - t AS d FROM jack))"


def rounded(df, *cols):
    return df.withColumns({c: round6(F.col(c)) for c in cols})


@query(
    "e01_stratified_split",
    """WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('42|' || doc_id), doc_id) AS place,
      count(*) OVER (PARTITION BY toxic) AS n FROM labels)
    SELECT doc_id, toxic, CASE WHEN place <= round(n * 0.7::DOUBLE) THEN 'train' WHEN place <= round(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def stratified_split(t):
    return splits.stratified_split(t.labels, "toxic", "doc_id").select("doc_id", "toxic", "split")


@query(
    "e02_stratified_folds",
    """WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('42|' || doc_id), doc_id) - 1 AS pos FROM labels)
    SELECT doc_id, toxic, (pos % 5)::INTEGER AS fold, (pos // 5 % 3)::INTEGER AS inner_fold FROM r""",
)
def stratified_folds(t):
    return splits.stratified_folds(t.labels, "toxic", "doc_id", 5, inner=3).select("doc_id", "toxic", "fold", "inner_fold")


@query(
    "e03_leave_one_group_out",
    """WITH g AS (SELECT source, row_number() OVER (ORDER BY md5('group|' || source), source) AS fold FROM (SELECT DISTINCT source FROM documents))
    SELECT doc_id, g.source, g.fold FROM documents d JOIN g ON d.source = g.source""",
)
def leave_one_group_out(t):
    return splits.leave_one_group_out(t.documents.select("doc_id", "source"), "source")


@query(
    "e04_hc50_bins",
    f"WITH {ASSAYS_SQL} SELECT peptide_id, CAST(ntile(7) OVER (ORDER BY hc50_um, peptide_id) AS INTEGER) AS bin FROM assays",
)
def hc50_bins(t):
    return splits.hc50_bins(t.assays().select("peptide_id", "hc50_um"), 7).select("peptide_id", "bin")


@query(
    "e05_smote",
    f"""WITH m AS (SELECT min(vec_id) AS id, x FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings WHERE label <= 1) GROUP BY x),
    d AS (SELECT a.id AS a_id, b.id AS b_id, list_distance(a.x, b.x) AS dist FROM m a JOIN m b ON a.id <> b.id),
    nn AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY dist, b_id) AS place FROM d QUALIFY place <= 5),
    k AS (SELECT a_id, count(*) AS k FROM nn GROUP BY 1),
    w AS (SELECT a_id, copy, {draw_sql("'smote|' || a_id || '|' || copy || '|pick'")} % k + 1 AS place,
      {draw_sql("'smote|' || a_id || '|' || copy || '|gap'")} / 4294967296.0::DOUBLE AS u FROM k, (SELECT unnest(range(1, 4)) AS copy)),
    p AS (SELECT w.a_id, nn.b_id, w.copy, u, a.x AS p, b.x AS q FROM w JOIN nn ON w.a_id = nn.a_id AND w.place = nn.place
      JOIN m a ON a.id = w.a_id JOIN m b ON b.id = nn.b_id)
    SELECT a_id, b_id, CAST(copy AS INTEGER) AS copy, list_transform(list_zip(p, q), lambda z: round(z[1] + u * (z[2] - z[1]), 6) + 0.0) AS x FROM p""",
)
def smote(t):
    """Labels 0 and 1 as the minority class, all elements of the vectors as features."""
    rows = t.embeddings.filter("label <= 1").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    made = splits.smote(rows, 5, 3, "vec_id")
    return made.withColumn("x", F.transform("x", round6))


@query(
    "e08_vote",
    f"""WITH {PREDICTIONS_SQL} SELECT peptide_id, {r6(f'''(p * 0.6 + CASE WHEN fold <> 0 THEN ({draw_sql("'m2|' || peptide_id")} % 1000) / 1000.0 * 0.4 ELSE 0 END)
      / CASE WHEN fold <> 0 THEN 1.0 ELSE 0.6 END::DOUBLE''')} AS p FROM predictions""",
)
def vote(t):
    """Two models; the second has no score for fold 0."""
    second = F.when(F.col("fold") != 0, draws.draw32(F.lit("m2"), "peptide_id") % 1000 / 1000.0)
    both = t.predictions().select("peptide_id", F.col("p").alias("m1"), second.alias("m2"))
    return ev.vote(both, {"m1": 0.6, "m2": 0.4}).select("peptide_id", round6("p").alias("p"))


@query(
    "e08_vote_validated",
    f"""WITH {PREDICTIONS_SQL}, m AS (SELECT peptide_id, fold, y, p AS m1, ({draw_sql("'m2|' || peptide_id")} % 1000) / 1000.0::DOUBLE AS m2 FROM predictions),
    w AS (SELECT 1 - avg((m1 - y) * (m1 - y)) AS w1, 1 - avg((m2 - y) * (m2 - y)) AS w2 FROM m WHERE fold = 1)
    SELECT peptide_id, {r6('(m1 * w1 + m2 * w2) / (w1 + w2)')} AS p FROM m, w WHERE fold <> 1""",
)
def vote_validated(t):
    """Two models weighted by their Brier scores on one fold, voting on the others."""
    second = draws.draw32(F.lit("m2"), "peptide_id") % 1000 / 1000.0
    both = t.predictions().select("peptide_id", "fold", "y", F.col("p").alias("m1"), second.alias("m2"))
    weights = ev.validation_weights(both.filter("fold = 1"), "y", ["m1", "m2"])
    return ev.vote(both.filter("fold <> 1"), weights).select("peptide_id", round6("p").alias("p"))


@query("e12_roc_curve", f"WITH {COUNTS_SQL} SELECT {r6('score')} AS threshold, {r6('tp / n_pos')} AS tpr, {r6('fp / n_neg')} AS fpr FROM cum")
def roc_curve(t):
    return rounded(ev.roc_curve(t.predictions()), "threshold", "tpr", "fpr")


@query(
    "e12_roc_auc",
    f"""WITH {PREDICTIONS_SQL}, pairs AS (SELECT a.fold, CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END::DOUBLE AS w
      FROM predictions a JOIN predictions b ON a.fold = b.fold AND a.y = 1 AND b.y = 0)
    SELECT f.fold, {r6('avg(w)')} AS auc FROM (SELECT DISTINCT fold FROM predictions) f LEFT JOIN pairs ON f.fold = pairs.fold GROUP BY 1""",
)
def roc_auc(t):
    return rounded(ev.roc_auc(t.predictions(), ["fold"]), "auc")


@query(
    "e13_delong_ci",
    f"""WITH {PREDICTIONS_SQL}, s AS (SELECT a.peptide_id AS i, b.peptide_id AS j, CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END::DOUBLE AS w
      FROM predictions a JOIN predictions b ON a.y = 1 AND b.y = 0),
    v1 AS (SELECT avg(v) AS auc, var_samp(v) / count(*) AS a FROM (SELECT i, avg(w) AS v FROM s GROUP BY 1)),
    v2 AS (SELECT var_samp(v) / count(*) AS b FROM (SELECT j, avg(w) AS v FROM s GROUP BY 1))
    SELECT {r6('auc')} AS auc, {r6('sqrt(a + b)')} AS se, {r6(f'greatest(0, auc - {ev.Z95!r} * sqrt(a + b))')} AS ci_low,
      {r6(f'least(1, auc + {ev.Z95!r} * sqrt(a + b))')} AS ci_high FROM v1, v2""",
)
def delong_ci(t):
    return rounded(ev.delong_ci(t.predictions()), "auc", "se", "ci_low", "ci_high")


def _half_wins(a: str, b: str) -> str:
    return f"CASE WHEN {a} > {b} THEN 1.0 WHEN {a} = {b} THEN 0.5 ELSE 0 END::DOUBLE"


@query(
    "e13_auc_test",
    f"""WITH {PREDICTIONS_SQL}, s AS (SELECT a.source, a.peptide_id AS i, b.peptide_id AS j, {_half_wins('a.p', 'b.p')} AS w
      FROM predictions a JOIN predictions b ON a.source = b.source AND a.y = 1 AND b.y = 0),
    v1 AS (SELECT source, avg(v) AS auc, var_samp(v) / count(*) AS a FROM (SELECT source, i, avg(w) AS v FROM s GROUP BY 1, 2) GROUP BY 1),
    v2 AS (SELECT source, var_samp(v) / count(*) AS b FROM (SELECT source, j, avg(w) AS v FROM s GROUP BY 1, 2) GROUP BY 1),
    t AS (SELECT source, auc, sqrt(a + b) AS se, (auc - 0.5) / nullif(sqrt(a + b), 0) AS z FROM v1 JOIN v2 USING (source))
    SELECT p.source, {r6('auc')} AS auc, {r6('se')} AS se, {r6('z')} AS z, {r6(f"1 - {phi_sql('z')}")} AS p_value
    FROM (SELECT DISTINCT source FROM predictions) p LEFT JOIN t ON p.source = t.source""",
)
def auc_test(t):
    """Is each source's AUC above one half?"""
    return rounded(ev.auc_test(t.predictions(), ["source"]), "auc", "se", "z", "p_value")


@query(
    "e13_delong_paired",
    f"""WITH {PREDICTIONS_SQL}, r AS (SELECT peptide_id, y, p, (p + ({draw_sql("'m2|' || peptide_id")} % 100) / 100.0::DOUBLE) / 2 AS q FROM predictions),
    s AS (SELECT a.peptide_id AS i, b.peptide_id AS j, {_half_wins('a.p', 'b.p')} AS u, {_half_wins('a.q', 'b.q')} AS v FROM r a JOIN r b ON a.y = 1 AND b.y = 0),
    o AS (SELECT avg(u) AS a, avg(v) AS b, (var_samp(u) + var_samp(v) - 2 * covar_samp(u, v)) / count(*) AS e FROM (SELECT i, avg(u) AS u, avg(v) AS v FROM s GROUP BY 1)),
    x AS (SELECT (var_samp(u) + var_samp(v) - 2 * covar_samp(u, v)) / count(*) AS f FROM (SELECT j, avg(u) AS u, avg(v) AS v FROM s GROUP BY 1)),
    t AS (SELECT a, b, sqrt(e + f) AS se, (a - b) / sqrt(e + f) AS z FROM o, x)
    SELECT {r6('a')} AS auc_p, {r6('b')} AS auc_q, {r6('a - b')} AS difference, {r6('se')} AS se, {r6('z')} AS z, {r6(f"2 * (1 - {phi_sql('abs(z)')})")} AS p_value FROM t""",
)
def delong_paired(t):
    """A score against its mean with a second one, on the same rows."""
    second = (F.col("p") + draws.draw32(F.lit("m2"), "peptide_id") % 100 / 100.0) / 2
    return rounded(ev.delong_paired(t.predictions().withColumn("q", second)), "auc_p", "auc_q", "difference", "se", "z", "p_value")


@query("e14_pr_curve", f"WITH {COUNTS_SQL} SELECT {r6('score')} AS threshold, {r6('tp / (tp + fp)')} AS precision, {r6('tp / n_pos')} AS recall FROM cum")
def pr_curve(t):
    return rounded(ev.pr_curve(t.predictions()), "threshold", "precision", "recall")


@query("e14_pr_auc", f"WITH {COUNTS_SQL} SELECT {r6('sum(pos * tp / (tp + fp)) / any_value(n_pos)')} AS average_precision FROM cum")
def pr_auc(t):
    return rounded(ev.pr_auc(t.predictions()), "average_precision")


@query("e15_brier", f"WITH {PREDICTIONS_SQL} SELECT fold, {r6('avg((p - y) * (p - y))')} AS brier FROM predictions GROUP BY 1")
def brier(t):
    return rounded(ev.brier(t.predictions(), ["fold"]), "brier")


BINS_SQL = f"{PREDICTIONS_SQL}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM predictions GROUP BY 1)"


@query("e15_calibration_bins", f"WITH {BINS_SQL} SELECT bin, n, {r6('mean_p')} AS mean_p, {r6('rate')} AS rate FROM b")
def calibration_bins(t):
    return rounded(ev.calibration_bins(t.predictions()), "mean_p", "rate")


@query("e15_ece", f"WITH {BINS_SQL} SELECT {r6('sum(n * abs(mean_p - rate)) / sum(n)')} AS ece FROM b")
def ece(t):
    return rounded(ev.ece(t.predictions()), "ece")


@query(
    "e16_confusion_metrics",
    f"""WITH {PREDICTIONS_SQL}, c AS (SELECT source, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
      count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn FROM predictions GROUP BY 1)
    SELECT source, tp, fp, fn, tn, {r6('(tp + tn) / nullif(tp + fp + fn + tn, 0)')} AS accuracy, {r6('tp / nullif(tp + fp, 0)')} AS precision,
      {r6('tp / nullif(tp + fn, 0)')} AS recall, {r6('tn / nullif(tn + fp, 0)')} AS specificity, {r6('2 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1,
      {r6('(tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0)')} AS mcc FROM c""",
)
def confusion_metrics(t):
    out = ev.confusion_metrics(t.predictions(), 0.5, ["source"])
    return rounded(out, "accuracy", "precision", "recall", "specificity", "f1", "mcc")


@query(
    "e17_regression_metrics",
    f"""WITH {REPLICATES_SQL}, p AS (SELECT occupancy, log10(value) AS y, log10(value * (0.9 + discount)) AS q FROM replicates)
    SELECT occupancy, {r6('avg(abs(q - y))')} AS mae, {r6('sqrt(avg((q - y) * (q - y)))')} AS rmse,
      {r6('1 - sum((q - y) * (q - y)) / (var_pop(y) * count(*))')} AS r2 FROM p GROUP BY 1""",
)
def regression_metrics(t):
    rows = t.replicates().select(
        "occupancy", F.log10("value").alias("y"), F.log10(F.col("value") * (F.col("discount") + 0.9)).alias("p")
    )
    return rounded(ev.regression_metrics(rows, keys=["occupancy"]), "mae", "rmse", "r2")


@query(
    "e18_youden_cutoff",
    f"""WITH {PREDICTIONS_SQL}, tr AS (SELECT f.fold AS f, p.p, p.y FROM predictions p, (SELECT DISTINCT fold FROM predictions) f WHERE p.fold <> f.fold),
    a AS (SELECT f, p, sum(y) AS pos, sum(1 - y) AS neg FROM tr GROUP BY 1, 2),
    j AS (SELECT f, p, round(sum(pos) OVER w / sum(pos) OVER (PARTITION BY f) - sum(neg) OVER w / sum(neg) OVER (PARTITION BY f), 12) AS j FROM a
      WINDOW w AS (PARTITION BY f ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    b AS (SELECT f AS fold, p AS cut, j AS youden FROM j QUALIFY row_number() OVER (PARTITION BY f ORDER BY j DESC, p DESC) = 1)
    SELECT CAST(b.fold AS INTEGER) AS fold, {r6('cut')} AS cut, {r6('youden')} AS youden,
      {r6('count(*) FILTER (WHERE p >= cut AND y = 1) / nullif(count(*) FILTER (WHERE y = 1), 0)')} AS sensitivity,
      {r6('count(*) FILTER (WHERE p < cut AND y = 0) / nullif(count(*) FILTER (WHERE y = 0), 0)')} AS specificity,
      {r6('(SELECT median(cut) FROM b)')} AS median_cut
    FROM predictions p JOIN b ON p.fold = b.fold GROUP BY b.fold, cut, youden""",
)
def youden_cutoff(t):
    return rounded(ev.youden_cutoff(t.predictions()), "cut", "youden", "sensitivity", "specificity", "median_cut")


def _rank_sql(*cols):
    return ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in cols)


@query(
    "e19_spearman",
    f"WITH {REPLICATES_SQL}, r AS (SELECT {_rank_sql('value', 'discount')} FROM replicates) SELECT {r6('corr(r_value, r_discount)')} AS rho FROM r",
)
def spearman(t):
    return rounded(ev.spearman(t.replicates(), "value", "discount"), "rho")


@query(
    "e19_kendall_tau",
    f"""WITH v AS (SELECT event_id AS i, value AS x, CAST(props->>'$.k' AS DOUBLE) AS y FROM events),
    s AS (SELECT sum((sign(a.x - b.x) * sign(a.y - b.y) > 0)::INTEGER)::BIGINT AS concordant, sum((sign(a.x - b.x) * sign(a.y - b.y) < 0)::INTEGER)::BIGINT AS discordant,
      count(*) FILTER (WHERE a.x <> b.x) AS ux, count(*) FILTER (WHERE a.y <> b.y) AS uy FROM v a JOIN v b ON a.i < b.i)
    SELECT concordant, discordant, {r6('(concordant - discordant) / sqrt(ux::DOUBLE * uy::DOUBLE)')} AS tau_b FROM s""",
)
def kendall_tau(t):
    rows = t.events.select(F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    return rounded(ev.kendall_tau(rows, "x", "y"), "tau_b")


@query(
    "e20_partial_spearman",
    f"""WITH {REPLICATES_SQL}, r AS (SELECT {_rank_sql('value', 'tax', 'se', 'discount')} FROM replicates),
    c AS (SELECT corr(r_value, r_tax) AS xy, corr(r_value, r_se) AS xa, corr(r_value, r_discount) AS xb, corr(r_tax, r_se) AS ya,
      corr(r_tax, r_discount) AS yb, corr(r_se, r_discount) AS ab FROM r),
    d AS (SELECT (xy - xb*yb) / sqrt((1-xb*xb)*(1-yb*yb)) AS xy, (xa - xb*ab) / sqrt((1-xb*xb)*(1-ab*ab)) AS xa,
      (ya - yb*ab) / sqrt((1-yb*yb)*(1-ab*ab)) AS ya FROM c)
    SELECT {r6('(xy - xa*ya) / sqrt((1-xa*xa)*(1-ya*ya))')} AS partial_rho FROM d""",
)
def partial_spearman(t):
    return rounded(ev.partial_spearman(t.replicates(), "value", "tax", ["se", "discount"]), "partial_rho")


def peptide_means(t):
    return t.replicates().groupBy("peptide_id").agg((F.round(F.sum("value"), 2) / F.count("*")).alias("value"))


@query(
    "e21_bootstrap_ci",
    f"""WITH {REPLICATES_SQL}, v AS (SELECT peptide_id, round(sum(value), 2) / count(*) AS value FROM replicates GROUP BY 1),
    i AS (SELECT value, row_number() OVER (ORDER BY md5('boot|' || peptide_id), peptide_id) - 1 AS item, count(*) OVER () AS n FROM v),
    d AS (SELECT rep, {draw_sql("'boot|' || rep || '|' || item")} % n AS item FROM i, (SELECT unnest(range(1, 1001)) AS rep)),
    s AS (SELECT rep, avg(i.value) AS stat FROM d JOIN i ON d.item = i.item GROUP BY 1)
    SELECT {r6('avg(stat)')} AS boot_mean, {r6('quantile_cont(stat, 0.025)')} AS ci_low, {r6('quantile_cont(stat, 0.975)')} AS ci_high FROM s""",
)
def bootstrap_ci(t):
    out = ev.bootstrap_ci(peptide_means(t), "peptide_id", "value", 1000)
    return rounded(out, "boot_mean", "ci_low", "ci_high")


MEANS_SQL = f"{REPLICATES_SQL}, v AS (SELECT peptide_id, round(sum(value), 2) / count(*) AS value, round(sum(tax), 2) / count(*) AS tax FROM replicates GROUP BY 1)"


def drawn_sql(table: str, columns: str, replicates: int) -> str:
    """CTEs i (columns, item, n) and d (rep, item): draws from the rows of `table` in digest order."""
    return f"""i AS (SELECT {columns}, row_number() OVER (ORDER BY md5('boot|' || peptide_id), peptide_id) - 1 AS item, count(*) OVER () AS n FROM {table}),
    d AS (SELECT rep, {draw_sql("'boot|' || rep || '|' || item")} % n AS item FROM i, (SELECT unnest(range(1, {replicates + 1})) AS rep))"""


@query(
    "e21_bootstrap_bca",
    f"""WITH RECURSIVE {MEANS_SQL}, {drawn_sql("v", "value", 10_000)},
    stats AS (SELECT rep, avg(i.value) AS stat FROM d JOIN i ON d.item = i.item GROUP BY 1), obs AS (SELECT avg(value) AS stat FROM v),
    jack AS (SELECT (sum(value) OVER () - value) / (n - 1) AS t FROM i), {ACC_SQL}, {bca_sql(10_000)}
    SELECT {r6('boot_mean')} AS boot_mean, {r6('ci_low')} AS ci_low, {r6('ci_high')} AS ci_high FROM ends""",
)
def bootstrap_bca(t):
    """BCa interval of the mean."""
    out = ev.bootstrap_ci(peptide_means(t), "peptide_id", "value", 10_000, method="bca")
    return rounded(out, "boot_mean", "ci_low", "ci_high")


@query(
    "e21_bootstrap_auc",
    f"""WITH RECURSIVE {PREDICTIONS_SQL}, {drawn_sql("predictions", "y, p", 10_000)},
    m AS (SELECT rep, p, sum(y) AS pos, sum(1 - y) AS neg FROM d JOIN i ON d.item = i.item GROUP BY 1, 2),
    w AS (SELECT rep, pos, neg, sum(neg) OVER (PARTITION BY rep ORDER BY p ROWS UNBOUNDED PRECEDING) - neg AS below FROM m),
    stats AS (SELECT rep, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE AS stat FROM w GROUP BY 1),
    x AS (SELECT a.item AS i, b.item AS j, CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END::DOUBLE AS h FROM i a JOIN i b ON a.y = 1 AND b.y = 0),
    k AS (SELECT sum(h) AS wins, count(DISTINCT i) AS m, count(DISTINCT j) AS n FROM x), obs AS (SELECT wins / (m * n) AS stat FROM k),
    jack AS (SELECT (wins - g) / ((m - 1) * n) AS t FROM k, (SELECT sum(h) AS g FROM x GROUP BY i)
      UNION ALL SELECT (wins - g) / (m * (n - 1)) FROM k, (SELECT sum(h) AS g FROM x GROUP BY j)), {ACC_SQL}, {bca_sql(10_000)}
    SELECT {r6('obs.stat')} AS observed, resamples, {r6('boot_mean')} AS boot_mean, {r6('ci_low')} AS ci_low, {r6('ci_high')} AS ci_high FROM ends, obs""",
)
def bootstrap_auc(t):
    """BCa interval of the AUC from 10,000 resamples of the scored rows."""
    out = resampling.bootstrap_rank_ci(t.predictions(), "peptide_id", "y", "p", "auc", 10_000)
    return rounded(out, "observed", "boot_mean", "ci_low", "ci_high")


def peptide_pairs(t):
    return t.replicates().groupBy("peptide_id").agg(*[(F.round(F.sum(c), 2) / F.count("*")).alias(c) for c in ("value", "tax")])


@query(
    "e21_bootstrap_spearman",
    f"""WITH RECURSIVE {MEANS_SQL}, {drawn_sql("v", "value AS x, tax AS y", 10_000)},
    r AS (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY x) + (count(*) OVER (PARTITION BY rep, x) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY rep ORDER BY y) + (count(*) OVER (PARTITION BY rep, y) - 1) / 2.0 AS ry FROM d JOIN i ON d.item = i.item),
    stats AS (SELECT rep, corr(rx, ry) AS stat FROM r GROUP BY 1),
    o AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM i, (SELECT item AS g FROM i UNION ALL SELECT -1) WHERE item <> g),
    l AS (SELECT g, corr(rx, ry) AS t FROM o GROUP BY 1), obs AS (SELECT t AS stat FROM l WHERE g = -1), jack AS (SELECT t FROM l WHERE g >= 0),
    {ACC_SQL}, {bca_sql(10_000)}
    SELECT {r6('obs.stat')} AS observed, resamples, {r6('boot_mean')} AS boot_mean, {r6('ci_low')} AS ci_low, {r6('ci_high')} AS ci_high FROM ends, obs""",
)
def bootstrap_spearman(t):
    """BCa interval of rho between two peptide means from 10,000 resamples of peptides."""
    out = resampling.bootstrap_rank_ci(peptide_pairs(t), "peptide_id", "value", "tax", "spearman", 10_000)
    return rounded(out, "observed", "boot_mean", "ci_low", "ci_high")


@query(
    "e22_permutation_test",
    f"""WITH {PREDICTIONS_SQL}, k AS (SELECT sum(y) AS m, count(*) AS n, sum(p) AS s, sum(p) FILTER (WHERE y = 1) AS s1 FROM predictions),
    o AS (SELECT *, s1 / m - (s - s1) / (n - m) AS obs FROM k),
    x AS (SELECT rep, p, row_number() OVER (PARTITION BY rep ORDER BY md5('perm|' || rep || '|' || peptide_id), peptide_id) AS place
      FROM predictions, (SELECT unnest(range(1, 10001)) AS rep)),
    g AS (SELECT rep, sum(p) AS s1 FROM x, o WHERE place <= m GROUP BY 1)
    SELECT {r6('obs')} AS observed, count(*) AS permutations,
      {r6('(count(*) FILTER (WHERE abs(g.s1 / m - (s - g.s1) / (n - m)) >= abs(obs) - 1e-12) + 1) / (count(*) + 1)')} AS p_value FROM g, o GROUP BY obs""",
)
def permutation_test(t):
    return rounded(ev.permutation_test(t.predictions(), "peptide_id", permutations=10_000), "observed", "p_value")


@query(
    "e22_permutation_auc",
    f"""WITH {PREDICTIONS_SQL}, r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS q FROM predictions),
    k AS (SELECT sum(y)::DOUBLE AS m, count(*)::DOUBLE AS n, sum(q) FILTER (WHERE y = 1) AS s1 FROM r), o AS (SELECT *, (s1 - m * (m + 1) / 2) / (m * (n - m)) AS obs FROM k),
    x AS (SELECT rep, q, row_number() OVER (PARTITION BY rep ORDER BY md5('perm|' || rep || '|' || peptide_id), peptide_id) AS place
      FROM r, (SELECT unnest(range(1, 10001)) AS rep)),
    g AS (SELECT rep, sum(q) AS s1 FROM x, o WHERE place <= m GROUP BY 1)
    SELECT {r6('obs')} AS observed, count(*) AS permutations,
      {r6('(count(*) FILTER (WHERE abs((g.s1 - m * (m + 1) / 2) / (m * (n - m)) - 0.5) >= abs(obs - 0.5) - 1e-12) + 1) / (count(*) + 1)')} AS p_value FROM g, o GROUP BY obs""",
)
def permutation_auc(t):
    return rounded(ev.permutation_auc(t.predictions(), "peptide_id", permutations=10_000), "observed", "p_value")


@query(
    "e22_permutation_rho",
    f"""WITH {MEANS_SQL}, r AS (SELECT peptide_id, {_rank_sql('value', 'tax')} FROM v),
    i AS (SELECT *, row_number() OVER (ORDER BY md5('perm|' || peptide_id), peptide_id) AS at FROM r),
    x AS (SELECT rep, r_value, row_number() OVER (PARTITION BY rep ORDER BY md5('perm|' || rep || '|' || peptide_id), peptide_id) AS at
      FROM i, (SELECT unnest(range(1, 10001)) AS rep)),
    g AS (SELECT rep, corr(x.r_value, i.r_tax) AS rho FROM x JOIN i ON x.at = i.at GROUP BY 1), o AS (SELECT corr(r_value, r_tax) AS obs FROM r)
    SELECT {r6('obs')} AS observed, count(*) AS permutations, {r6('(count(*) FILTER (WHERE abs(rho) >= abs(obs) - 1e-12) + 1) / (count(*) + 1)')} AS p_value
    FROM g, o GROUP BY obs""",
)
def permutation_rho(t):
    return rounded(ev.permutation_rho(peptide_pairs(t), "peptide_id", "value", "tax", 10_000), "observed", "p_value")


@query(
    "e23_wilcoxon_signed_rank",
    f"""WITH d AS (SELECT value - 35 AS d, round(abs(value - 35), 6) AS a FROM events WHERE round(value - 35, 6) <> 0),
    r AS (SELECT d, a, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM d),
    t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY a)),
    w AS (SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, count(*) AS n FROM r)
    SELECT w_plus, n, {r6('(w_plus - n * (n + 1) / 4.0) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48)')} AS z FROM w, t""",
)
def wilcoxon(t):
    return rounded(ev.wilcoxon_signed_rank(t.events.select(F.round(F.col("value") - 35, 6).alias("d0")), "d0"), "z")


@query(
    "e24_decision_curve",
    f"""WITH {PREDICTIONS_SQL}, th AS (SELECT unnest([{', '.join(f'{c!r}::DOUBLE' for c in THRESHOLDS)}]) AS threshold),
    c AS (SELECT threshold, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE p >= threshold AND y = 0) AS fp,
      count(*) AS n, avg(y) AS share FROM predictions, th GROUP BY 1)
    SELECT threshold, tp, fp, {r6('tp / n - fp / n * (threshold / (1 - threshold))')} AS net_benefit,
      {r6('share - (1 - share) * (threshold / (1 - threshold))')} AS treat_all FROM c""",
)
def decision_curve(t):
    return rounded(ev.decision_curve(t.predictions(), THRESHOLDS), "net_benefit", "treat_all")


@query(
    "e26_decision_verdict",
    f"""WITH {REPLICATES_SQL}, m AS (SELECT peptide_id, occupancy, avg(discount) * 8 AS rho, avg(se) / 34 AS auc FROM replicates GROUP BY 1, 2)
    SELECT peptide_id, occupancy, CASE WHEN rho >= 0.5 AND auc >= 0.8 THEN 'validated' WHEN rho < 0.3 AND auc <= 0.65 THEN 'weak' ELSE 'borderline' END AS verdict FROM m""",
)
def decision_verdict(t):
    m = t.replicates().groupBy("peptide_id", "occupancy").agg((F.avg("discount") * 8).alias("rho"), (F.avg("se") / 34).alias("auc"))
    return m.select("peptide_id", "occupancy", ev.decision_verdict(F.col("rho"), F.col("auc")).alias("verdict"))
