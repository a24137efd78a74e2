"""The metamodel: Spark ML models over pair features that predict who gains from a join."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, RandomForestClassifier,
)
from pyspark.ml.feature import PCA, MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinlift.functions import hash32, materialise, with_one_row
from joinlift.operators.ensembles import fit_forest, is_forest
from joinlift.operators.impute import drop_z_outliers
from joinlift.operators.report import classification_report, prediction_errors
from joinlift.operators.splits import folds
from joinlift.schema import MODEL_FEATURES, PAIR

TREES = 100
DEPTH = 10
ROWS_PER_PARTITION = 10_000
FEW_PARTITIONS = 48              # each sends every open node's sums once a level, so beyond these they grow with FULL_PARTITION
FULL_PARTITION = 1_000_000
MAX_PARTITIONS = 10_000
FOREST_ROWS = 100_000            # forests of more training rows are grown by ``forests``, not by Spark ML


def partitions_of(n: int) -> int:
    few = min(FEW_PARTITIONS, math.ceil(n / ROWS_PER_PARTITION))
    return min(MAX_PARTITIONS, max(1, few, math.ceil(n / FULL_PARTITION)))


def in_fixed_order(rows: DataFrame, key: Sequence[str] = PAIR,
                   partitions: int | None = None) -> DataFrame:
    """The same rows in the same partitions on every run: forests draw per partition.

    The number of partitions follows the number of rows alone, not the cluster.
    """
    if partitions is None:
        partitions = partitions_of(rows.count())
    return rows.repartition(partitions, *key).sortWithinPartitions(*key)


def regressors(seed: int = 42, trees: int = TREES, depth: int = DEPTH) -> dict[str, object]:
    """The user-model and metamodel regressors by name."""
    io = dict(featuresCol="features", labelCol="label")
    return {
        "linear": LinearRegression(solver="normal", **io),
        "sgd": LinearRegression(solver="l-bfgs", **io),
        "random forest": RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, **io),
        "boosted trees": GBTRegressor(maxDepth=5, maxIter=trees, seed=seed, **io),
        "decision tree": DecisionTreeRegressor(maxDepth=depth, seed=seed, **io),
    }


def classifiers(seed: int = 42, trees: int = TREES, depth: int = DEPTH) -> dict[str, object]:
    io = dict(featuresCol="features", labelCol="label")
    return {
        "random forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **io),
        "boosted trees": GBTClassifier(maxDepth=5, maxIter=trees, seed=seed, **io),
        "linear svm": LinearSVC(**io),
    }


def _fit(rows: DataFrame, features: Sequence[str], label: Column, estimator, scale: str,
         key: Sequence[str]) -> PipelineModel:
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw")]
    if scale == "minmax":
        stages.append(MinMaxScaler(inputCol="raw", outputCol="features"))
    elif scale == "standard":
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    else:
        stages[0].setOutputCol("features")
    data = rows.na.fill(0.0, list(features)).withColumn("label", label.cast("double")).select(*key, *features, "label")
    if is_forest(estimator):
        data = materialise(data)
        if data.count() > FOREST_ROWS:
            before = Pipeline(stages=stages).fit(data)
            own = before.transform(data).select(*key, vector_to_array("features").alias("xs"), "label")
            return PipelineModel([*before.stages, fit_forest(own, list(key), len(features), estimator)])
    ready = in_fixed_order(data, key).persist()
    try:
        return Pipeline(stages=[*stages, estimator]).fit(ready)
    finally:
        ready.unpersist()


def train_classifier(rows: DataFrame, features: Sequence[str] = MODEL_FEATURES,
                     label: str = "class", positive: str = "gain", kind: str = "random forest",
                     seed: int = 42, trees: int = TREES, depth: int = DEPTH,
                     key: Sequence[str] = PAIR) -> PipelineModel:
    """Scaled features and a classifier of the positive class."""
    scale = "standard" if kind == "linear svm" else "minmax"
    return _fit(rows, features, F.col(label) == positive,
                classifiers(seed, trees, depth)[kind], scale, key)


def train_regressor(rows: DataFrame, features: Sequence[str] = MODEL_FEATURES,
                    label: str = "gain", above: float | None = None, kind: str = "random forest",
                    seed: int = 42, trees: int = TREES, depth: int = DEPTH,
                    key: Sequence[str] = PAIR) -> PipelineModel:
    """A regressor of the gain; ``above`` trains on gains over that value only."""
    if above is not None:
        rows = rows.where(F.col(label) > above)
    return _fit(rows, features, F.col(label), regressors(seed, trees, depth)[kind], "minmax", key)


def _refit_scaler(model: PipelineModel, rows: DataFrame) -> PipelineModel:
    """The same model behind a scaler fitted on the batch to be scored."""
    assembler, *rest = model.stages
    scaler = MinMaxScaler(inputCol="raw", outputCol="features").fit(assembler.transform(rows))
    return PipelineModel([assembler, scaler, *rest[1:]])


def apply_classifier(model: PipelineModel, rows: DataFrame, features: Sequence[str] = MODEL_FEATURES,
                     out: str = "score", rescale: str = "training") -> DataFrame:
    """p(gain) as ``score`` and the predicted class. A margin classifier gives its margin."""
    filled = rows.na.fill(0.0, list(features))
    if rescale == "batch":
        model = _refit_scaler(model, filled)
    scored = model.transform(filled)
    source = "probability" if "probability" in scored.columns else "rawPrediction"
    drop = [c for c in ("raw", "features", "rawPrediction", "probability", "prediction")
            if c in scored.columns]
    return scored.withColumn(out, F.get(vector_to_array(source), F.lit(1))).withColumn(
        "pred_class", F.when(F.col("prediction") == 1, "gain").otherwise("loss")).drop(*drop)


def apply_regressor(model: PipelineModel, rows: DataFrame, features: Sequence[str] = MODEL_FEATURES,
                    out: str = "score") -> DataFrame:
    scored = model.transform(rows.na.fill(0.0, list(features)))
    return scored.withColumnRenamed("prediction", out).drop("raw", "features")


def scorer(model: PipelineModel, features: Sequence[str] = MODEL_FEATURES,
           regression: bool = False) -> Callable[[DataFrame], DataFrame]:
    """The model as a DataFrame -> DataFrame step for the pruners."""
    apply = apply_regressor if regression else apply_classifier
    return lambda rows: apply(model, rows, features)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel, spark, features: Sequence[str], name: str = "") -> DataFrame:
    """(model, feature, importance): one row per feature, so driver-sized."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(name, f, float(v)) for f, v in zip(features, values)],
                                 "model string, feature string, importance double")


def mean_importances(parts: Sequence[DataFrame]) -> DataFrame:
    """Importances averaged over folds or models."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("feature").agg(F.avg("importance").alias("importance"),
                                       F.count(F.lit(1)).alias("n_models"))


def cross_validate(rows: DataFrame, k: int, features: Sequence[str], target: str = "gain",
                   kind: str = "random forest", z_limit: float = 0.5, save_to: str | None = None,
                   trees: int = TREES, depth: int = DEPTH,
                   key: Sequence[str] = PAIR) -> tuple[DataFrame, list[PipelineModel]]:
    """One model per fold on outlier-filtered rows, with R2, MSE and SMAPE on the held-out rows."""
    split = materialise(folds(rows, key, k))
    models, parts = [], []
    for fold in range(k):
        train = drop_z_outliers(split.where(F.col("fold") != fold), [target], z_limit)
        test = drop_z_outliers(split.where(F.col("fold") == fold), [target], z_limit)
        model = train_regressor(train, features, target, kind=kind, trees=trees, depth=depth, key=key)
        if save_to:
            save(model, f"{save_to}/fold={fold}")
        predicted = materialise(apply_regressor(model, test, features, "predicted").select(target, "predicted"))
        spread = predicted.agg(F.var_pop(target).alias("v"))
        errors = with_one_row(prediction_errors(predicted, target, "predicted"), spread).select(
            F.lit(fold).alias("fold"), "n", "mse", "smape",
            (1 - F.col("mse") / F.nullif(F.col("v"), F.lit(0.0))).alias("r2"))
        models.append(model)
        parts.append(errors)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, models


def seed_flips(train: DataFrame, test: DataFrame, features: Sequence[str], seeds=(42, 17),
               **kw) -> DataFrame:
    """Test rows with both predictions and whether two seeds disagree."""
    a, b = (apply_classifier(train_classifier(train, features, seed=s, **kw), test, features,
                             f"p_{i}").withColumnRenamed("pred_class", f"pred_{i}")
            for i, s in enumerate(seeds))
    return a.join(b.select(*PAIR, "p_1", "pred_1"), PAIR).withColumn(
        "flips", F.col("pred_0") != F.col("pred_1"))


def both_positive(first: str, second: str, positive: str = "gain", negative: str = "loss") -> Column:
    return F.when((F.col(first) == positive) & (F.col(second) == positive), positive).otherwise(
        negative)


def nearest_centroid(train: DataFrame, test: DataFrame, features: Sequence[str],
                     label: str, positive: str = "gain", negative: str = "loss") -> DataFrame:
    """The class whose mean is nearer; ``negative`` on a tie."""
    centres = train.agg(*[
        F.avg(F.when(F.col(label) == c, F.col(f))).alias(f"__{i}_{f}")
        for i, c in enumerate((positive, negative)) for f in features])
    def distance(i):
        total = F.lit(0.0)
        for f in features:
            d = F.col(f) - F.col(f"__{i}_{f}")
            total = total + d * d
        return total
    met = with_one_row(test, centres)
    return met.withColumn("pred", F.when(distance(0) < distance(1), positive).otherwise(
        negative)).drop(*[f"__{i}_{f}" for i in (0, 1) for f in features])


def transfer(train: Mapping[str, DataFrame], test: Mapping[str, DataFrame],
             features: Sequence[str], mix: float = 0.0, label: str = "class", **kw) -> DataFrame:
    """Train on each corpus and report on each other; ``mix`` adds that share of the test corpus
    to the training rows (and takes it out of the test rows)."""
    out = None
    for a, rows in train.items():
        for b, other in test.items():
            taken = hash32(*PAIR, seed="mix") % 1000 < int(mix * 1000)
            seen = rows.unionByName(other.where(taken), allowMissingColumns=True) if mix else rows
            left = other.where(~taken) if mix else other
            model = train_classifier(seen, features, label, **kw)
            scored = materialise(apply_classifier(model, left, features).select(label, "pred_class"))
            r = classification_report(scored, label, "pred_class")
            r = r.withColumns({"trained_on": F.lit(a), "tested_on": F.lit(b)})
            out = r if out is None else out.unionByName(r)
    return out


def threshold_grid(train: DataFrame, test: DataFrame, features: Sequence[str], alphas: Sequence[float],
                   gain: str = "gain", positive: str = "gain", **kw) -> DataFrame:
    """F1 of the positive class for each gain threshold alpha."""
    from joinlift.operators.labels import by_threshold
    out = None
    for alpha in alphas:
        model = train_classifier(by_threshold(train, alpha, gain, "__class"), features, "__class", **kw)
        scored = materialise(apply_classifier(model, by_threshold(test, alpha, gain, "__class"), features).select("__class", "pred_class"))
        f1 = classification_report(scored, "__class", "pred_class").where(
            F.col("class") == positive).select(F.lit(float(alpha)).alias("alpha"), "precision",
                                               "recall", "f1", "support")
        out = f1 if out is None else out.unionByName(f1)
    return out


def interval_grid(scored: DataFrame, betas: Sequence[float], probability: str, label: str = "class",
                  predicted: str = "pred_class") -> DataFrame:
    """Reports of the rows with a probability more than beta away from 0.5, for every beta at once."""
    ladder = F.array(*[F.lit(float(b)) for b in betas])
    kept = scored.withColumn("beta", F.explode(F.filter(
        ladder, lambda b: F.abs(F.col(probability) - 0.5) > b)))
    return classification_report(kept, label, predicted, ["beta"])


def best_step(grid: DataFrame, step: str, positive: str = "gain", group: Sequence[str] = ()) -> DataFrame:
    """The step of a grid (alpha, beta) with the highest F1 of the positive class; the smallest on a tie."""
    own = grid.where(F.col("class") == positive) if "class" in grid.columns else grid
    return own.groupBy(*group).agg(F.min_by(step, F.struct(-F.col("f1"), F.col(step))).alias(step), F.max("f1").alias("f1"))


def theta_grid(scored: DataFrame, thetas: Sequence[float], label: str = "class",
               predicted: str = "pred_class", theta_of: str = "containment") -> DataFrame:
    """Reports of one model on the versions ``theta_of >= theta`` of a test set."""
    from joinlift.operators.profile import versions_by_threshold
    return classification_report(versions_by_threshold(scored, list(thetas), theta_of), label,
                                 predicted, ["theta"])


def principal_components(rows: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """Standardised features projected on their first k principal components."""
    model = Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__std", withMean=True),
        PCA(k=k, inputCol="__std", outputCol="__pca")]).fit(rows)
    projected = model.transform(rows).withColumn("__a", vector_to_array("__pca"))
    return projected.select(*rows.columns, *[
        F.get("__a", F.lit(i)).alias(f"pc{i + 1}") for i in range(k)])
