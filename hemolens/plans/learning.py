"""Models (E06, E07, E09-E11, E15 slope, E25, E27)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hemolens.functions import sequence
from hemolens.operators import evaluation as ev, models
from hemolens.plans.binding import PREDICTIONS_SQL, REPLICATES_SQL, r6, round6
from hemolens.plans.catalog import query

FEATURES = [f"f{i}" for i in range(64)]


def vectors(t):
    """All embedding elements as features, upper half of the labels as the class."""
    e = F.col("embedding")
    return t.embeddings.select(
        F.col("vec_id").alias("peptide_id"), F.col("label"), (F.col("label") >= 5).cast("int").alias("y"),
        *[e[i].cast("double").alias(f) for i, f in enumerate(FEATURES)],
        (F.col("label") * 25.0 + 1).alias("hc50_um"),
    )


@query("e06_fit_logistic_ridge")
def fit_logistic_ridge(t):
    """Out-of-fold predictions of nested cross-validation, summarised per fold."""
    out = models.fit_logistic_ridge(vectors(t), FEATURES, "peptide_id", grid=(0.01, 0.1, 1.0, 10.0), outer=5, inner=5)
    return ev.roc_auc(out, ["fold"]).select("fold", F.round("auc", 3).alias("auc"))


@query("e07_fit_boosted")
def fit_boosted(t):
    """Boosted class model on sequence descriptors of whole labelled texts, scored on its own rows."""
    seq = F.col("sequence")
    rows = t.canonical().join(t.labels.select(F.col("doc_id").alias("peptide_id"), "toxic"), "peptide_id").select(
        "peptide_id", "toxic", F.length(seq).cast("double").alias("length"), sequence.gravy(seq).alias("gravy"),
        sequence.net_charge_ph(seq).alias("charge"),
    )
    model = models.fit_boosted(rows, ["length", "gravy", "charge"], "toxic", depths=(3,), rates=(0.1,), trees=(100,))
    scored = model.transform(rows).select("peptide_id", F.col("toxic").alias("y"), vector_to_array("probability")[1].alias("p"))
    return ev.confusion_metrics(scored).select("tp", "fp", "fn", "tn", F.round("accuracy", 3).alias("accuracy"))


@query("e07_search_boosted")
def search_boosted(t):
    """Every fit of a random search over depth 3-8, rate 0.01-0.1 and 100-500 trees, on all labelled texts."""
    seq = F.col("sequence")
    rows = t.canonical().join(t.labels.select(F.col("doc_id").alias("peptide_id"), "toxic"), "peptide_id").select(
        "peptide_id", "toxic", F.length(seq).cast("double").alias("length"), sequence.gravy(seq).alias("gravy"),
        sequence.net_charge_ph(seq).alias("charge"),
    )
    _, trail = models.search_boosted(rows, ["length", "gravy", "charge"], "toxic", "peptide_id", settings=models.drawn_settings(8, 42))
    return trail.withColumns({"rate": F.round("rate", 6), "score": F.round("score", 4)})


@query("e07_fit_boosted_regression")
def fit_boosted_regression(t):
    """Boosted regression of log10 HC50."""
    rows = vectors(t).withColumn("log_hc50", F.log10("hc50_um"))
    model = models.fit_boosted(rows, FEATURES, "log_hc50", task="regression", trees=(100,))
    scored = model.transform(rows).select(F.col("log_hc50").alias("y"), F.col("prediction").alias("p"))
    out = ev.regression_metrics(scored)
    return out.select(*[F.round(c, 3).alias(c) for c in out.columns])


@query(
    "e09_linear_attribution",
    f"""WITH {REPLICATES_SQL},
    m AS (SELECT sum(CAST(se AS DECIMAL(28,2)))::DOUBLE / count(se) AS mse, sum(CAST(tax AS DECIMAL(28,2)))::DOUBLE / count(tax) AS mtax FROM replicates),
    a AS (SELECT peptide_id, occupancy, CAST(0.7::DOUBLE * (se - mse) AS DECIMAL(28,9)) AS c1, CAST(-1.5::DOUBLE * (tax - mtax) AS DECIMAL(28,9)) AS c2
      FROM replicates, m)
    SELECT peptide_id, occupancy, count(*) AS n, CAST(round(sum(c1), 6) AS DOUBLE) AS contrib_se, CAST(round(sum(c2), 6) AS DOUBLE) AS contrib_tax
    FROM a GROUP BY 1, 2""",
)
def linear_attribution(t):
    """Contributions per peptide and occupancy; sums are exact, so no order of addition changes a digit."""
    rows = t.replicates()
    out = models.linear_attribution(rows, {"se": 0.7, "tax": -1.5}, models.exact_means(rows, ["se", "tax"], 2))
    total = lambda c: F.round(F.sum(F.col(c).cast("decimal(28,9)")), 6).cast("double").alias(c)
    return out.groupBy("peptide_id", "occupancy").agg(F.count("*").alias("n"), total("contrib_se"), total("contrib_tax"))


@query("e10_permutation_importance")
def permutation_importance(t):
    rows = vectors(t)
    model = models.fit_logistic(rows, FEATURES)
    out = models.permutation_importance(model, rows, FEATURES, "peptide_id")
    return out.select("feature", F.round("importance", 3).alias("importance"))


@query(
    "e11_standardize",
    f"""WITH {REPLICATES_SQL}, z AS (SELECT peptide_id, occupancy, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS zv,
      (discount - avg(discount) OVER ()) / stddev_samp(discount) OVER () AS zd FROM replicates)
    SELECT peptide_id, occupancy, {r6('sum(zv)')} AS z_value, {r6('sum(zd)')} AS z_discount FROM z GROUP BY 1, 2""",
)
def standardize(t):
    out = models.standardize(t.replicates().select("peptide_id", "occupancy", "value", "discount"), ["value", "discount"])
    return out.groupBy("peptide_id", "occupancy").agg(
        round6(F.sum("z_value")).alias("z_value"), round6(F.sum("z_discount")).alias("z_discount")
    )


@query("e11_pca")
def pca(t):
    out = models.pca(vectors(t), FEATURES, 2)
    return out.select("peptide_id", F.round(F.abs("pc1"), 4).alias("pc1"), F.round(F.abs("pc2"), 4).alias("pc2"))


def _total(term: str) -> str:
    return f"list_sum(list_transform(range(1, len(x) + 1), lambda i: {term}))"


_P = "(1 / (1 + exp(-(a + b * x[i]))))"


@query(
    "e15_calibration_line",
    f"""WITH RECURSIVE {PREDICTIONS_SQL}, l AS (SELECT y, least(1 - 1e-6, greatest(1e-6, p)) AS p FROM predictions),
    d AS (SELECT list(ln(p / (1 - p)) ORDER BY p, y) AS x, list(y::DOUBLE ORDER BY p, y) AS y FROM l),
    it AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0 AS k UNION ALL
      SELECT a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), k + 1 FROM (
        SELECT a, b, k, {_total(f"y[i] - {_P}")} AS g0, {_total(f"(y[i] - {_P}) * x[i]")} AS g1, {_total(f"{_P} * (1 - {_P})")} AS h00,
          {_total(f"{_P} * (1 - {_P}) * x[i]")} AS h01, {_total(f"{_P} * (1 - {_P}) * x[i] * x[i]")} AS h11 FROM it, d WHERE k < 20))
    SELECT round(b, 3) + 0.0 AS slope, round(a, 3) + 0.0 AS intercept FROM it WHERE k = 20""",
)
def calibration_line(t):
    """Logistic line through the logits; the SQL makes 20 Newton steps."""
    line = models.calibration_line(t.predictions())
    return line.select(*[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("slope", "intercept")])


@query("e25_adversarial_validation")
def adversarial_validation(t):
    """Labels below 3 as the training set, the rest as the test set."""
    rows = vectors(t)
    out = models.adversarial_validation(rows.filter("label < 3"), rows.filter("label >= 3"), FEATURES, "peptide_id")
    return out.select(F.round("auc", 3).alias("auc"))


@query("e27_score_batch")
def score_batch(t):
    rows = vectors(t)
    model = models.fit_logistic(rows, FEATURES)
    out = models.score_batch(model, rows.drop("y", "label"), FEATURES, explain=True)
    return out.select(
        "peptide_id", F.round("p", 3).alias("p"), "toxic_class", "high_toxicity",
        *[F.round(f"contrib_{f}", 3).alias(f"contrib_{f}") for f in FEATURES],
    )
