"""Quality classifier by co-training two views: what a text says, and what its metadata says.

Each view has its own logistic regression: one on hashed words and word endings of the text,
one on source, language and length. Both start from the labelled rows. In every round each
view labels all unlabelled rows that it is sure of, and the other view learns from them. Held-out
labelled rows then calibrate both views (Platt) and weigh them against each other, and every
document gets the combined probability.

Only the labelled rows are a bounded sample, `most_labelled` of them, chosen by a hash of the id.
How rare a term is is counted over all documents, every unlabelled one takes part in each round, and
all are scored. Texts are read once: which terms a text has is kept in the shared folder, about two
bytes a term, and weights by rarity are put to them where they are read. Nothing but counts,
gradients and the labelled sample leaves the tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, FeatureHasher, HashingTF, IDFModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemolens.llm.common import lower_ascii
from hemolens.session import cut_lineage

TEXT_BINS, META_BINS = 1 << 14, 1 << 10


def text_terms(text: Column) -> Column:
    """Distinct words in lower case, and the last three characters of each."""
    found = F.array_distinct(F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), ""))
    return F.concat(found, F.transform(found, lambda w: F.concat(F.lit("~"), F.substring(w, -3, 3))))


def meta_columns() -> dict[str, Column]:
    size = F.coalesce(F.length("text"), F.lit(0))
    return {
        "_m_source": F.coalesce("source", F.lit("-")),
        "_m_lang": F.coalesce("lang", F.lit("-")),
        "_m_size": F.floor(F.log2(size + 1.0) * 2).cast("string"),
        "_m_stated": F.when(F.col("n_chars") == size, "same").otherwise("other"),
    }


def featurised(docs: DataFrame) -> tuple[DataFrame, IDFModel]:
    """`docs` but its text, with the sparse vectors `_text_x` and `_meta_x`, and the model of how rare terms are in them.

    What is written has the terms without weights: all values are one, so only their numbers take room.
    """
    meta = meta_columns()
    counts = HashingTF(numFeatures=TEXT_BINS, binary=True, inputCol="_terms", outputCol="_tf")
    rows = counts.transform(docs.withColumn("_terms", text_terms(F.col("text"))).withColumns(meta))
    rows = FeatureHasher(numFeatures=META_BINS, inputCols=list(meta), outputCol="_meta_x").transform(rows)
    rows = cut_lineage(rows.drop("text", "_terms", *meta))
    rarity = IDF(inputCol="_tf", outputCol="_rare").fit(rows)
    rows = Normalizer(p=2.0, inputCol="_rare", outputCol="_text_x").transform(rarity.transform(rows))
    return rows.drop("_tf", "_rare"), rarity


def fit_view(rows: DataFrame, features: str, rounds: int) -> LogisticRegressionModel:
    """`rows` has y, w and the features; the weights make both classes count alike."""
    return LogisticRegression(
        featuresCol=features, labelCol="y", weightCol="w", maxIter=rounds, regParam=1e-5, standardization=False,
        probabilityCol=f"{features}_p", rawPredictionCol=f"{features}_r", predictionCol=f"{features}_d",
    ).fit(rows)


def log_odds(df: DataFrame, model: LogisticRegressionModel, out: str) -> DataFrame:
    name = model.getFeaturesCol()
    return model.transform(df).withColumn(out, vector_to_array(f"{name}_r")[1]).drop(f"{name}_p", f"{name}_r", f"{name}_d")


def balanced(rows: DataFrame) -> DataFrame:
    n = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    weight = F.lit(1.0)
    for y, k in n.items():
        weight = F.when(F.col("y") == y, sum(n.values()) / (len(n) * k)).otherwise(weight)
    return rows.withColumn("w", weight)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights (intercept first) of a small logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def score_quality(
    docs: DataFrame, labels: DataFrame, rounds: int = 2, sure: float = 0.95, most_labelled: int = 8_000,
    steps: int = 20, least: float = 0.5,
) -> DataFrame:
    """Per row of `docs`: doc_id, `text_score`, `meta_score`, `score` (probabilities) and `kept`.

    A labelled row is good if `quality` is 1 and `toxic` is not 1; several labels of one id must
    all say so, and a null quality is no label. `docs` needs doc_id, text, lang, source, n_chars;
    nulls are values of their own. With labels of one class only there is nothing to learn: all
    scores are that class; with too few of either to hold some out, all are 0.5. Repeated rows and ties get equal scores.
    """
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)
    y = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good.cast("int")).cast("double").alias("y"))
    n_labels = y.count()
    draw = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000_000)) / 1e9
    marks = y.filter(draw("labelled") < min(1.0, most_labelled / max(n_labels, 1)))
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    bounded = F.broadcast(cut_lineage(marks))  # about `most_labelled` rows
    held = draw("held") < 0.25
    there = base.select("doc_id").join(bounded, "doc_id").groupBy(held.alias("held"), "y").count().collect()  # 4 rows at most
    if len({(r["held"], r["y"]) for r in there}) < 4:  # one class, or too few rows to hold some of both out
        classes = {r["y"] for r in there}
        p = classes.pop() if len(classes) == 1 else 0.5
        one = {c: F.lit(float(p)) for c in ("text_score", "meta_score", "score")}
        return base.select("doc_id").withColumns({**one, "kept": F.lit(p >= least)})
    vectors = featurised(base)[0].select("doc_id", "_text_x", "_meta_x")
    labelled = cut_lineage(vectors.join(bounded, "doc_id").withColumn("held", held))
    pool = vectors.filter(F.col("doc_id").isNotNull()).join(bounded.select("doc_id"), "doc_id", "left_anti")
    start = labelled.filter("not held").select("y", "_text_x", "_meta_x")
    edge = float(np.log(sure / (1 - sure)))
    for_text = for_meta = start
    for turn in range(rounds + 1):
        text_model = fit_view(balanced(for_text), "_text_x", steps)
        meta_model = fit_view(balanced(for_meta), "_meta_x", steps)
        if turn == rounds:
            break
        pick = lambda m: log_odds(pool, m, "_o").filter(F.abs("_o") >= edge).withColumn("y", (F.col("_o") > 0).cast("double"))
        for_meta = start.unionByName(pick(text_model).select("y", "_text_x", "_meta_x"))
        for_text = start.unionByName(pick(meta_model).select("y", "_text_x", "_meta_x"))
    checked = log_odds(log_odds(labelled.filter("held"), text_model, "_t"), meta_model, "_m").select("y", "_t", "_m")
    sample = np.array([tuple(r) for r in checked.collect()])  # about a quarter of `most_labelled`
    ty, tt, tm = sample.T
    of_text, of_meta = logistic(tt[:, None], ty), logistic(tm[:, None], ty)
    both = logistic(np.column_stack([of_text[0] + of_text[1] * tt, of_meta[0] + of_meta[1] * tm]), ty)
    scored = log_odds(log_odds(vectors, text_model, "_t"), meta_model, "_m")
    line = lambda b, c: F.lit(float(b[0])) + F.lit(float(b[1])) * F.col(c)
    p = lambda z: 1.0 / (1.0 + F.exp(-z))
    total = F.lit(float(both[0])) + F.lit(float(both[1])) * line(of_text, "_t") + F.lit(float(both[2])) * line(of_meta, "_m")
    return scored.select(
        "doc_id", p(line(of_text, "_t")).alias("text_score"), p(line(of_meta, "_m")).alias("meta_score"), p(total).alias("score"),
    ).withColumn("kept", F.col("score") >= least)
