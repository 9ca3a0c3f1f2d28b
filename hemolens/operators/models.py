"""Models on pyspark.ml (E06, E07, E10, E11, E25, E27) and linear attributions (E09)."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemolens.functions import draws
from hemolens.functions.scalars import flag_high_toxicity
from hemolens.operators.evaluation import roc_auc
from hemolens.operators.splits import hash_order, stratified_folds, stratified_split
from hemolens.session import cut_lineage


def probability() -> Column:
    return vector_to_array("probability")[1]


def _scaled(features: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
    ]


def training_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The needed columns written once, so that every pass of a fit reads numbers and not their origin."""
    return cut_lineage(df.select(*columns))


def fit_logistic(df: DataFrame, features: Sequence[str], y: str = "y", ridge: float = 0.1) -> PipelineModel:
    lr = LogisticRegression(featuresCol="_features", labelCol=y, elasticNetParam=0.0, regParam=ridge, maxIter=50)
    return Pipeline(stages=[*_scaled(features), lr]).fit(training_table(df, [*features, y]))


def fit_logistic_ridge(df: DataFrame, features: Sequence[str], ident: str, y: str = "y",
                       grid: Sequence[float] = (0.01, 0.1, 1.0, 10.0), outer: int = 5, inner: int = 5) -> DataFrame:
    """Out-of-fold predictions (id, fold, y, p, ridge) of nested stratified cross-validation.

    Every outer fold picks its penalty on the inner folds of its training rows; scaling is part
    of what is fitted on each inner fold. The loop is over folds; each fit is a distributed job.
    """
    folded = cut_lineage(stratified_folds(df.select(ident, y, *features), y, ident, outer, inner))
    parts = []
    for fold in range(outer):
        train, test = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        lr = LogisticRegression(featuresCol="_features", labelCol=y, elasticNetParam=0.0, maxIter=50)
        search = CrossValidator(
            estimator=Pipeline(stages=[*_scaled(features), lr]),
            estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, list(grid)).build(),
            evaluator=BinaryClassificationEvaluator(labelCol=y), numFolds=inner, foldCol="inner_fold", parallelism=len(grid),
        )
        fitted = search.fit(train).bestModel
        ridge = fitted.stages[-1].getRegParam()
        scored = fitted.transform(test)
        parts.append(scored.select(ident, "fold", F.col(y).alias("y"), probability().alias("p"), F.lit(ridge).alias("ridge")))
    return reduce(DataFrame.unionByName, parts)


def fit_boosted(df: DataFrame, features: Sequence[str], target: str, task: str = "class", depths: Sequence[int] = (3,),
                rates: Sequence[float] = (0.1,), trees: Sequence[int] = (100,), folds: int = 3, seed: int = 42):
    """Boosted trees for a class or for log10 HC50; the grid is chosen by cross-validation."""
    kind = GBTClassifier if task == "class" else GBTRegressor
    trainer = kind(featuresCol="_raw", labelCol=target, seed=seed)
    grid = (
        ParamGridBuilder().addGrid(trainer.maxDepth, list(depths)).addGrid(trainer.stepSize, list(rates))
        .addGrid(trainer.maxIter, list(trees)).build()
    )
    judge = BinaryClassificationEvaluator(labelCol=target) if task == "class" else RegressionEvaluator(labelCol=target, metricName="mae")
    search = trainer if len(grid) == 1 else CrossValidator(
        estimator=trainer, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed
    )
    if len(grid) == 1:
        trainer.setParams(**{p.name: v for p, v in grid[0].items()})
    return Pipeline(stages=[_scaled(features)[0], search]).fit(training_table(df, [*features, target]))


def drawn_settings(count: int, seed: int | str, depth=(3, 8), rate=(0.01, 0.1), trees=(100, 500)) -> list[dict]:
    """`count` seeded draws: depth and trees uniform over whole numbers, rate uniform in its logarithm; ends included."""

    def unit(k: int, name: str) -> float:
        return int(hashlib.md5(f"{seed}|{k}|{name}".encode()).hexdigest()[:8], 16) / 2**32

    whole = lambda ends, u: ends[0] + int(u * (ends[1] - ends[0] + 1))
    return [
        {
            "depth": whole(depth, unit(k, "depth")), "rate": rate[0] * (rate[1] / rate[0]) ** unit(k, "rate"),
            "trees": whole(trees, unit(k, "trees")),
        }
        for k in range(count)
    ]


def search_boosted(
    df: DataFrame, features: Sequence[str], target: str, ident: str, task: str = "class", settings: Sequence[dict] | None = None,
    first_trees: int = 10, held_out: float = 0.2, tolerance: float = 0.001, seed: int = 42, at_once: int = 4,
) -> tuple[PipelineModel, DataFrame]:
    """(model, trail) of boosted trees with settings chosen by random search and successive halving.

    A fixed share of the rows (of each class) in digest order is held out. All settings are fitted with a
    few trees; the better half by held-out AUC (classes) or mean absolute error (numbers), ties to the
    earlier draw, goes on with twice as many, until one is left. That one is fitted with its own number of
    trees, and stops early once held-out loss no longer falls by `tolerance`. The trail has a row for each
    fit: round, draw, depth, rate, trees asked for and grown, score, chosen. Fits are distributed jobs.
    """
    settings = list(settings or drawn_settings(12, seed))
    strata = target if task == "class" else "_all"
    rows = df.select(ident, target, *features).withColumn("_all", F.lit(0))
    split = stratified_split(rows, strata, ident, {"fit": 1 - held_out, "hold": held_out}, seed)
    table = cut_lineage(split.withColumn("_hold", F.col("split") == "hold").select(target, *features, "_hold"))
    fit, hold = table.filter(~F.col("_hold")), table.filter("_hold")
    kind = GBTClassifier if task == "class" else GBTRegressor
    judge = BinaryClassificationEvaluator(labelCol=target) if task == "class" else RegressionEvaluator(labelCol=target, metricName="mae")
    sign = 1 if task == "class" else -1
    trail: list[tuple] = []

    def fitted(stage: int, k: int, trees: int, last: bool):
        s = settings[k]
        trainer = kind(featuresCol="_raw", labelCol=target, seed=seed, maxDepth=s["depth"], stepSize=s["rate"], maxIter=trees)
        if last:
            trainer.setParams(validationIndicatorCol="_hold", validationTol=tolerance)
        model = Pipeline(stages=[_scaled(features)[0], trainer]).fit(table if last else fit)
        score = float(judge.evaluate(model.transform(hold)))
        return model, (stage, k, s["depth"], s["rate"], trees, model.stages[-1].getNumTrees, score, last)

    open_, stage, trees = list(range(len(settings))), 1, first_trees
    while len(open_) > 1:
        with ThreadPoolExecutor(at_once) as pool:  # a fit is a chain of small jobs; several fill the cluster
            rows = list(pool.map(lambda k: fitted(stage, k, min(trees, settings[k]["trees"]), False)[1], open_))
        trail += rows
        scores = {r[1]: r[6] for r in rows}
        open_ = sorted(open_, key=lambda k: (-sign * scores[k], k))[: (len(open_) + 1) // 2]
        stage, trees = stage + 1, 2 * trees
    model, row = fitted(stage, open_[0], settings[open_[0]]["trees"], True)
    trail.append(row)
    schema = "round int, draw int, depth int, rate double, trees int, grown int, score double, chosen boolean"
    return model, df.sparkSession.createDataFrame(trail, schema)


def exact_means(df: DataFrame, columns: Sequence[str], digits: int) -> dict[str, float]:
    """Means of columns of `digits` decimals, from exact sums: no order of addition changes them."""
    sums = [F.sum(F.col(c).cast(f"decimal(28,{digits})")).cast("double") / F.count(c) for c in columns]
    return df.agg(*[m.alias(c) for m, c in zip(sums, columns)]).first().asDict()


def linear_attribution(df: DataFrame, beta: dict[str, float], means: dict[str, float] | None = None) -> DataFrame:
    """`contrib_<feature>` = coefficient times distance from the feature's mean.

    `means` are those of the rows that the coefficients were fitted on; by default those of `df`.
    """
    means = means or df.agg(F.struct(*[F.avg(c).alias(c) for c in beta])).first()[0].asDict()
    means = {c: F.lit(m) for c, m in means.items()}
    return df.withColumns({f"contrib_{c}": b * (F.col(c) - means[c]) for c, b in beta.items()})


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], ident: str, y: str = "y",
                           seed: str = "shuffle") -> DataFrame:
    """(feature, importance): drop in AUC when the feature's column is shuffled between rows.

    One pairing of rows (equal places in two md5 orders) serves all features; each row is
    scored once per feature.
    """
    rows = df.select(ident, y, *features)
    target = hash_order(rows, [], ident, f"{seed}-to", "_place")
    donor = hash_order(rows.select(ident, *features), [], ident, f"{seed}-from", "_place").select(
        "_place", *[F.col(c).alias(f"_d_{c}") for c in features]
    )
    paired = target.join(donor, "_place").withColumn("feature", F.explode(F.array(*[F.lit(c) for c in features])))
    mixed = paired.select(
        ident, y, "feature", *[F.when(F.col("feature") == c, F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) for c in features]
    )

    def scored(d: DataFrame) -> DataFrame:
        return model.transform(d).select(*[c for c in d.columns if c == "feature"], F.col(y).alias("y"), probability().alias("p"))

    base = roc_auc(scored(rows)).agg(F.first("auc")).scalar()
    return roc_auc(scored(mixed), ["feature"]).select("feature", (base - F.col("auc")).alias("importance"))


def standardize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Centre and scale by the sample sd, as `z_<feature>`."""
    fitted = Pipeline(stages=_scaled(features)).fit(df)
    scaled = fitted.transform(df).withColumn("_a", vector_to_array("_features"))
    return scaled.withColumns({f"z_{c}": F.col("_a")[i] for i, c in enumerate(features)}).drop("_a", "_raw", "_features")


def pca(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """First k principal components of the standardised features as `pc1`..`pck`."""
    stages = [*_scaled(features), PCA(k=k, inputCol="_features", outputCol="_pcs")]
    out = Pipeline(stages=stages).fit(df).transform(df).withColumn("_a", vector_to_array("_pcs"))
    return out.withColumns({f"pc{i + 1}": F.col("_a")[i] for i in range(k)}).drop("_a", "_raw", "_features", "_pcs")


def adversarial_validation(train: DataFrame, test: DataFrame, features: Sequence[str], ident: str) -> DataFrame:
    """AUC of telling test rows from training rows, cross-fitted on two halves; near 0.5 means alike."""
    both = train.select(ident, *features, F.lit(0).alias("y")).unionByName(test.select(ident, *features, F.lit(1).alias("y")))
    halves = cut_lineage(both.withColumn("_half", draws.draw_index(2, F.lit("adv"), ident)))
    parts = []
    for half in (0, 1):
        model = fit_logistic(halves.filter(F.col("_half") != half), features)
        parts.append(model.transform(halves.filter(F.col("_half") == half)).select("y", probability().alias("p")))
    return roc_auc(parts[0].unionByName(parts[1]))


def calibration_line(df: DataFrame) -> DataFrame:
    """Slope and intercept of the outcome on the logit of the prediction."""
    clipped = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("p")))
    logit = df.select("y", F.log(clipped / (1 - clipped)).alias("x"))
    stages = [VectorAssembler(inputCols=["x"], outputCol="_f"), LogisticRegression(featuresCol="_f", labelCol="y", maxIter=100, tol=1e-10)]
    fitted = Pipeline(stages=stages).fit(logit).stages[-1]
    return df.sparkSession.createDataFrame(
        [(float(fitted.coefficients[0]), float(fitted.intercept))], "slope double, intercept double"
    )


def score_batch(model: PipelineModel, peptides: DataFrame, features: Sequence[str], explain: bool = False,
                cut: float = 0.5, hc50: str = "hc50_um") -> DataFrame:
    """Probability and class for every peptide, the high-toxicity flag always, attributions on request."""
    scored = model.transform(peptides).withColumn("p", probability())
    out = scored.drop("_raw", "_features", "rawPrediction", "probability", "prediction").withColumns(
        {"toxic_class": (F.col("p") >= cut).cast("int"), "high_toxicity": flag_high_toxicity(F.col(hc50))}
    )
    if not explain:
        return out
    coefficients = model.stages[-1].coefficients
    scaler = model.stages[1]
    beta = {c: float(b) / float(s or 1.0) for c, b, s in zip(features, coefficients, scaler.std)}
    return linear_attribution(out, beta, {c: float(m) for c, m in zip(features, scaler.mean)})
