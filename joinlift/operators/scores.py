"""Scores of the user's model before and after an augmentation, for many pairs at once.

The linear model of every pair is fitted from sums of products (``products``): each task adds up its
own rows with numpy, so the shuffle is as large as the models, not the rows. Predictions and errors are built-in
expressions again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinlift.functions import group_median, materialise, meet
from joinlift.operators.forests import fit_forests, predict_forests
from joinlift.operators.impute import best_strategy, fill_value
from joinlift.operators.joins import with_row_id
from joinlift.operators.metamodel import DEPTH, TREES, in_fixed_order, partitions_of, regressors
from joinlift.operators.products import fit_linear
from joinlift.operators.splits import hold_out
from joinlift.schema import PAIR

ERRORS = ("mae", "mse", "medae", "r2")
TIE = 1e-9         # errors that differ by no more than this part of them are equal


def absolute_gain(before: str, after: str) -> Column:
    return F.col(after) - F.col(before)


def relative_gain(before: str, after: str) -> Column:
    """(after - before) / |before|; null for a missing or zero ``before``."""
    return (F.col(after) - F.col(before)) / F.abs(F.nullif(F.col(before), F.lit(0.0)))


def relative_change(before: str, after: str) -> Column:
    """(after - before) / before: negative is better for an error."""
    return (F.col(after) - F.col(before)) / F.nullif(F.col(before), F.lit(0.0))


def adjusted_r2(r2: Column, n: Column, p: Column) -> Column:
    """1 - (1 - R2)(n - 1)/(n - p - 1); null where n - p - 1 is 0."""
    return 1 - (1 - r2) * (n - 1) / F.nullif(n - p - 1, F.lit(0))


def improvement_flags(scores: DataFrame) -> DataFrame:
    """Per metric: is the score after better than before?"""
    return scores.withColumns({
        **{f"{m}_improved": F.col(f"{m}_after") < F.col(f"{m}_before")
           for m in ("mae", "mse", "medae")},
        "r2_improved": F.col("r2_after") > F.col("r2_before")})


def relative_targets(scores: DataFrame) -> DataFrame:
    return scores.withColumns({
        "decrease_in_mae": relative_change("mae_before", "mae_after"),
        "decrease_in_mse": relative_change("mse_before", "mse_after"),
        "decrease_in_medae": relative_change("medae_before", "medae_after"),
        "gain_in_r2_score": relative_gain("r2_before", "r2_after")})


def _joined_rows(pairs: DataFrame, cells: DataFrame, inner: bool = False) -> DataFrame:
    """The rows of ``model_rows`` before candidate values are filled."""
    pairs = materialise(pairs.select(*PAIR).distinct())
    ids = pairs.select(F.col("query_id").alias("dataset_id")).union(
        pairs.select(F.col("candidate_id").alias("dataset_id"))).distinct()
    used = meet(cells, ids, ["dataset_id"], ["row_key", "col"], "left_semi")
    columns = used.groupBy("dataset_id").agg(F.sort_array(F.collect_set("col")).alias("cols"))

    def rows(*at):
        """Values in the order of the columns; what repeats is averaged first, so a frequent key never fills a row."""
        unique = used.groupBy("dataset_id", *at, "col").agg(F.avg("v").alias("v"))
        return unique.groupBy("dataset_id", *at).agg(F.sort_array(F.collect_list(F.struct("col", "v"))).alias("vs"))
    by_key = materialise(rows("row_key"))                            # both sides read it
    if "row_id" not in cells.columns:
        by_row = by_key.withColumn("row_id", F.col("row_key"))       # the same grouping serves both sides
    else:
        by_row = rows("row_id", "row_key")

    def in_order(vs, cols):
        """A row that has every column is in their order already; any other is looked up."""
        vs, cols = F.col(vs), F.col(cols)
        return F.when(F.size(vs) == F.size(cols), vs["v"]).otherwise(
            F.transform(cols, lambda c: F.element_at(F.map_from_entries(vs), c)))
    q_cols = columns.select(F.col("dataset_id").alias("query_id"), F.col("cols").alias("q_cols"))
    c_cols = columns.select(F.col("dataset_id").alias("candidate_id"), F.col("cols").alias("c_cols"))
    shape = materialise(pairs.join(q_cols, "query_id").join(c_cols, "candidate_id"))
    q_rows = by_row.select(F.col("dataset_id").alias("query_id"), "row_id", "row_key", F.col("vs").alias("qv"))
    c_rows = by_key.select(F.col("dataset_id").alias("candidate_id"), "row_key", F.col("vs").alias("cv"))
    met = meet(q_rows, shape, ["query_id"], ["row_id"]).join(
        c_rows, ["candidate_id", "row_key"], "inner" if inner else "left")
    met = met.withColumns({"qx": in_order("qv", "q_cols"), "cx": in_order("cv", "c_cols"),
                           "at": F.array_position("q_cols", F.col("target")).cast("int") - 1})
    return met.select(
        *PAIR, "row_id", "row_key", F.get("qx", F.col("at")).alias("y"),
        F.transform(F.filter("qx", lambda v, i: i != F.col("at")), lambda v: F.coalesce(v, F.lit(0.0))).alias("qx"), "cx").where("y is not null")


def _fills(wide: DataFrame, strategy: str) -> DataFrame:
    """Per pair, the array ``ms`` of what replaces a missing value of each candidate feature; 0 where nothing matched."""
    values = wide.select(*PAIR, F.posexplode("cx").alias("i", "v"))
    if strategy == "mean":
        fills = fill_value(values, [*PAIR, "i"], "v", strategy)
    else:                                                            # a column without any match has no fill of its own
        fills = values.select(*PAIR, "i").distinct().join(fill_value(values, [*PAIR, "i"], "v", strategy), [*PAIR, "i"], "left")
    return fills.groupBy(*PAIR).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "fill"))),
                    lambda e: F.coalesce(e["fill"], F.lit(0.0))).alias("ms"))


def _filled(cx, ms) -> Column:
    return F.zip_with(cx, ms, lambda v, m: F.coalesce(v, m))


def model_rows(pairs: DataFrame, cells: DataFrame, *, inner: bool = False, strategy: str = "mean") -> DataFrame:
    """One row per (pair, query row): target ``y``, query features ``qx``, candidate features ``cx``.

    Arrays follow the column names in order. Missing candidate values are the mean (or
    median, or most frequent: ``strategy``) of the matched ones (0 if none), or with ``inner`` rows with a missing value are dropped. A query's
    key may repeat where ``cells`` has ``row_id``, which the result has in any case.
    """
    wide = _joined_rows(pairs, cells, inner)
    if inner:
        return wide.where(~F.exists("cx", lambda v: v.isNull()))
    wide = materialise(wide)
    return meet(wide, materialise(_fills(wide, strategy)), PAIR, ["row_id"], "left").withColumn("cx", _filled("cx", "ms")).drop("ms")


def predict_linear(rows: DataFrame, coefs: DataFrame, group: list[str],
                   spread: list[str]) -> DataFrame:
    met = meet(rows, materialise(coefs), group, spread)
    product = F.zip_with("xs", F.slice("coef", 2, F.size("xs")), lambda x, b: x * b)
    return met.withColumn("yhat", F.aggregate(product, F.get("coef", F.lit(0)), lambda a, v: a + v)) \
        .drop("coef")


def error_scores(predicted: DataFrame, group: list[str]) -> DataFrame:
    """MAE, MSE, median absolute error and R2 of ``yhat`` against ``y``."""
    e = F.col("y") - F.col("yhat")
    plain = predicted.groupBy(*group).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop("y").alias("__v"))
    medians = group_median(predicted.withColumn("__e", F.abs(e)), group, "__e", "medae")
    return plain.join(medians, group).select(
        *group, "mae", "mse", "medae",
        (1 - F.col("mse") / F.nullif(F.col("__v"), F.lit(0.0))).alias("r2"))


def _by_stage(errors: DataFrame) -> DataFrame:
    return errors.groupBy(*PAIR).agg(*[
        F.max(F.when(F.col("stage") == s, F.col(m))).alias(f"{m}_{s}")
        for m in ERRORS for s in ("before", "after")])


def _both_stages(rows: DataFrame) -> DataFrame:
    """Each row with the query's features alone, and with the candidate's."""
    return rows.select(*PAIR, "row_id", "is_train", "y", F.inline(F.array(
        F.struct(F.lit("before").alias("stage"), F.col("qx").alias("xs")),
        F.struct(F.lit("after").alias("stage"), F.concat("qx", "cx").alias("xs")))))


def _forest_settings(seed: int = 42, trees: int = TREES, depth: int = DEPTH) -> dict:
    return dict(seeds=(seed,), trees=trees, depth=depth)


def before_and_after(pairs: DataFrame, cells: DataFrame, *, inner: bool = False,
                     seed: str = "42", strategy: str = "mean") -> DataFrame:
    """Hold-out scores of the linear user model with the query alone and with the candidate.

    Both models see the same training rows; a row's side is a hash of its id (of its key, where rows have none).
    """
    rows = hold_out(model_rows(pairs, cells, inner=inner, strategy=strategy), "row_id", seed=seed)
    both = _both_stages(materialise(rows) if inner else rows)        # rows that are filled come from a stored table
    group = [*PAIR, "stage"]
    coefs = fit_linear(both.where("is_train"), group)
    predicted = predict_linear(both.where("not is_train"), coefs, group, ["row_id"])
    return _by_stage(error_scores(materialise(predicted.select(*group, "y", "yhat")), group))


def before_and_after_with(kind: str, pairs: DataFrame, cells: DataFrame, *, inner: bool = False, seed: str = "42",
                          strategy: str = "mean", **model) -> DataFrame:
    """The same scores of another user model (a name of ``metamodel.regressors``), with features scaled on the training rows.

    Random forests of all pairs and stages are grown together (``forests``). Any other kind is a fit per pair on all executors, so it is for
    the finalists that the pruners leave.
    The target keeps its unit: a linear scale of it changes neither R2 nor relative errors. A query
    without features is fitted on a constant. Pairs without training rows have no scores.
    """
    rows = hold_out(model_rows(pairs, cells, inner=inner, strategy=strategy), "row_id", seed=seed)
    if kind == "random forest":
        both = materialise(_both_stages(rows))
        group = [*PAIR, "stage"]
        forests = fit_forests(both.where("is_train"), group, ["row_id"], **_forest_settings(**model))
        predicted = predict_forests(both.where("not is_train").select(*group, "row_id", "xs", "y"), forests, group, ["row_id"])
        return _by_stage(error_scores(materialise(predicted.select(*group, "y", "yhat")), group))
    rows = materialise(rows)
    counts = rows.where("is_train").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).collect()   # one row per finalist
    predicted = rows.where("false").select(*PAIR, F.lit("").alias("stage"), "y", F.lit(0.0).alias("yhat"))
    for pair in counts:
        own = rows
        for c in PAIR:
            own = own.where(F.col(c).eqNullSafe(F.lit(pair[c])))
        for stage, xs in (("before", F.col("qx")), ("after", F.concat("qx", "cx"))):
            ready = own.select("row_id", "is_train", "y", F.col("y").alias("label"), array_to_vector(
                F.when(F.size(xs) == 0, F.array(F.lit(0.0))).otherwise(xs)).alias("raw"))
            train = in_fixed_order(ready.where("is_train"), ["row_id"], partitions_of(pair["n"])).persist()
            try:
                fitted = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True),
                                          regressors(**model)[kind]]).fit(train)
            finally:
                train.unpersist()
            predicted = predicted.unionByName(fitted.transform(ready.where("not is_train")).select(
                *[F.lit(pair[c]).alias(c) for c in PAIR], F.lit(stage).alias("stage"), "y", F.col("prediction").alias("yhat")))
    return _by_stage(error_scores(materialise(predicted), [*PAIR, "stage"]))


def with_best_imputation(pairs: DataFrame, cells: DataFrame, strategies: Sequence[str] = ("mean", "median", "most_frequent"),
                         *, seed: str = "42") -> DataFrame:
    """Scores under the imputation whose model after the join has the lowest MAE; ``strategy`` names it.

    Rows are joined once and carry the fills of all strategies; the model before the join and one per strategy are fitted
    in the same job. Errors that differ by rounding alone are a tie, which goes to the first name.
    """
    wide = materialise(hold_out(_joined_rows(pairs, cells), "row_id", seed=seed).drop("row_key"))
    each = [_fills(wide, s).select(*PAIR, F.lit(s).alias("stage"), "ms") for s in strategies]
    fills = materialise(reduce(DataFrame.unionByName, each).groupBy(*PAIR).agg(F.collect_list(F.struct("stage", "ms")).alias("fills")))
    rows = meet(wide, fills, PAIR, ["row_id"], "left")
    both = rows.select(*PAIR, "row_id", "is_train", "y", F.inline(F.concat(          # once per stage, so not stored
        F.array(F.struct(F.lit("before").alias("stage"), F.col("qx").alias("xs"))),
        F.transform("fills", lambda f: F.struct(f["stage"].alias("stage"), F.concat("qx", _filled(F.col("cx"), f["ms"])).alias("xs"))))))
    group = [*PAIR, "stage"]
    coefs = fit_linear(both.where("is_train"), group)
    predicted = predict_linear(both.where("not is_train"), coefs, group, ["row_id"])
    predicted = materialise(predicted.select(*group, "y", "yhat"))
    errors = materialise(error_scores(predicted, group))
    before = errors.where("stage = 'before'").select(*PAIR, *[F.col(m).alias(f"{m}_before") for m in ERRORS])
    after = errors.where("stage <> 'before'").withColumnRenamed("stage", "strategy")
    least = after.groupBy(*PAIR).agg(F.min("mae").alias("least"))
    near = after.join(least, PAIR).withColumn("mae", F.when(F.col("mae") <= F.col("least") * (1 + TIE), F.col("least")).otherwise(F.col("mae")))
    best = best_strategy(near, PAIR).select(*PAIR, "strategy")
    after = after.join(best, [*PAIR, "strategy"]).select(*PAIR, "strategy", *[F.col(m).alias(f"{m}_after") for m in ERRORS])
    return before.join(after, PAIR)


def training_records(scores: DataFrame, strategy: str | None = "mean",
                     mark: Column | None = None, algorithm: str | None = None) -> DataFrame:
    """Scores in the shape of training records: one [before, after] array per metric, and the ``algorithm`` where given."""
    names = {"mae": "mean_absolute_error", "mse": "mean_squared_error",
             "medae": "median_absolute_error", "r2": "r2_score"}
    return scores.select(
        F.col("query_id").alias("query_dataset"), "target",
        F.col("candidate_id").alias("candidate_dataset"),
        F.lit(strategy).cast("string").alias("imputation_strategy"),
        (mark if mark is not None else F.lit(None).cast("string")).alias("mark"),
        *[F.array(f"{m}_before", f"{m}_after").alias(n) for m, n in names.items()],
        *([F.lit(algorithm).alias("algorithm")] if algorithm else []))
