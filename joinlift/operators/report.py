"""Classification reports, error analysis and comparisons of distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlift.functions import group_median, with_one_row
from joinlift.operators.impute import drop_mad_outliers, drop_z_outliers
from joinlift.operators.labels import QUERY
from joinlift.operators.profile import histogram
from joinlift.operators.rank import rank_by


def _ratio(a, b):
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def classification_report(rows: DataFrame, actual: str, predicted: str,
                          group: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages.

    Only the confusion counts leave the first aggregation. ``group`` makes one report per value.
    """
    group = list(group)
    cells = rows.groupBy(*group, F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("c"))
    sides = cells.select(*group, "c", F.explode(F.array(
        F.struct(F.col("a").alias("class"), F.lit("a").alias("side"),
                 (F.col("a") == F.col("p")).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit("p").alias("side"),
                 F.lit(False).alias("hit")))).alias("s")).select(*group, "c", "s.*")
    per = sides.groupBy(*group, "class").agg(
        F.sum(F.when(F.col("side") == "a", F.col("c")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side") == "p", F.col("c")).otherwise(0)).alias("said"),
        F.sum(F.when(F.col("hit"), F.col("c")).otherwise(0)).alias("hits"))
    precision, recall = _ratio(F.col("hits"), F.col("said")), _ratio(F.col("hits"), F.col("support"))
    per = per.select(*group, "class", "support", "hits", precision.alias("precision"),
                     recall.alias("recall"), _ratio(2 * precision * recall, precision + recall)
                     .alias("f1"))
    total = F.sum("support")
    def weighted(c):
        return F.sum(F.col(c) * F.col("support")) / total
    averages = per.groupBy(*group).agg(
        total.alias("support"), (F.sum("hits") / total).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])
    def line(name, p, r, f):
        return F.struct(F.lit(name).alias("class"), F.col(p).alias("precision"),
                        F.col(r).alias("recall"), F.col(f).alias("f1"))
    lines = averages.select(*group, "support", F.explode(F.array(
        line("accuracy", "accuracy", "accuracy", "accuracy"),
        line("macro avg", "macro_precision", "macro_recall", "macro_f1"),
        line("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1"))).alias("l"))
    columns = [*group, "class", "precision", "recall", "f1", "support"]
    return per.select(*columns).unionByName(lines.select(*group, "l.*", "support").select(*columns))


def outcome_tags(rows: DataFrame, actual: str, predicted: str, positive: str = "gain") -> DataFrame:
    a, p = F.col(actual) == positive, F.col(predicted) == positive
    return rows.withColumn("outcome", F.when(a & p, "tp").when(a, "fn").when(p, "fp")
                           .otherwise("tn"))


def precision_recall(tagged: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Counts of the four outcomes with precision and recall of the positive class."""
    counts = tagged.groupBy(*group).agg(*[
        F.count_if(F.col("outcome") == t).alias(t) for t in ("tp", "fp", "tn", "fn")])
    return counts.withColumns({
        "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def recall_per_query(rows: DataFrame, actual: str, predicted: str, positive: str = "gain",
                     group: Sequence[str] = QUERY) -> DataFrame:
    """Share of each query's true positives that were predicted; queries without any are left out."""
    a = F.col(actual) == positive
    return rows.groupBy(*group).agg(
        F.count_if(a).alias("n_real"),
        F.count_if(a & (F.col(predicted) == positive)).alias("n_found")).where(
        "n_real > 0").withColumn("found_share", F.col("n_found") / F.col("n_real"))


def top_gain_recall(rows: DataFrame, k: int, predicted: str, alpha: float = 0.0,
                    gain: str = "gain", positive: str = "gain",
                    group: Sequence[str] = QUERY, **kw) -> DataFrame:
    """Share of the k best gains predicted positive, for queries with k gains above ``alpha``."""
    placed = rank_by(rows.where(F.col(gain).isNotNull()), gain, "r", group, **kw)
    top = placed.where((F.col("r") <= k) & (F.col(gain) > alpha))
    return top.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col(predicted) == positive) / k).alias("top_recall")).where(
        F.col("n") >= k).drop("n")


def candidates_per_query(rows: DataFrame, group: Sequence[str] = QUERY) -> DataFrame:
    """Mean and median number of candidates."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("c"))
    mean = sizes.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("c").alias("mean_candidates"))
    middle = group_median(sizes.withColumn("one", F.lit(1)), ["one"], "c", "median_candidates")
    return with_one_row(mean, middle.drop("one"))


def prediction_errors(rows: DataFrame, real: str, predicted: str, group: Sequence[str] = ()):
    """MSE and SMAPE (a row with both values 0 counts as no error)."""
    r, p = F.col(real), F.col(predicted)
    sape = F.coalesce(2 * F.abs(p - r) / F.nullif(F.abs(r) + F.abs(p), F.lit(0.0)), F.lit(0.0))
    return rows.groupBy(*group).agg(F.avg((p - r) * (p - r)).alias("mse"),
                                    (100 * F.avg(sape)).alias("smape"),
                                    F.count(F.lit(1)).alias("n"))


def error_distributions(rows: DataFrame, real: str, predicted: str,
                        normalise: bool = False) -> DataFrame:
    """Squared and symmetric absolute percentage error per row, optionally over their maximum."""
    r, p = F.col(real), F.col(predicted)
    out = rows.withColumns({
        "squared_error": (p - r) * (p - r),
        "sape": 2 * F.abs(p - r) / F.nullif(F.abs(r) + F.abs(p), F.lit(0.0))})
    if not normalise:
        return out
    tops = out.agg(F.max("squared_error").alias("__a"), F.max("sape").alias("__b"))
    return with_one_row(out, tops).withColumns({
        "squared_error": F.col("squared_error") / F.nullif(F.col("__a"), F.lit(0.0)),
        "sape": F.col("sape") / F.nullif(F.col("__b"), F.lit(0.0))}).drop("__a", "__b")


def quadrants(rows: DataFrame, real: str, predicted: str) -> DataFrame:
    r, p = F.col(real) > 0, F.col(predicted) > 0
    which = F.when(r & p, 1).when(p, 2).when(~r, 3).otherwise(4)
    return rows.where(F.col(real).isNotNull() & F.col(predicted).isNotNull()).groupBy(
        which.alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))


def compare_distributions(rows: DataFrame, side: str, value: str, bins: int = 50,
                          outliers: str | None = "mad", spread: Sequence[str] = ()) -> DataFrame:
    """Histogram shares of a value on each side (train/test, gain/loss), without its outliers."""
    clean = rows.where(F.col(value).isNotNull())
    spread = list(spread) or [value]
    if outliers == "mad":
        clean = drop_mad_outliers(clean, value, group=[side], spread=spread)
    elif outliers == "zscore":
        clean = drop_z_outliers(clean, [value], group=[side], spread=spread)
    return histogram(clean, [side], value, bins)


def probability_histogram(rows: DataFrame, probability: str = "p_gain") -> DataFrame:
    """20 bins over [0, 1] with shares."""
    return histogram(rows, [], probability, 20, 0.0, 1.0)


def uncertain_share(rows: DataFrame, probability: str = "p_gain", low: float = 0.4,
                    high: float = 0.6) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"),
                    F.avg(F.col(probability).between(low, high).cast("double"))
                    .alias("uncertain_share"))


def predicted_list(rows: DataFrame, by: str = "p_gain") -> DataFrame:
    """Candidates predicted as gain, best first."""
    return rows.where("pred_class = 'gain'").select(
        "query_id", "target", "candidate_id", by, "gain", "containment").orderBy(
        F.desc(by), "query_id", "candidate_id")


def corpus_statistics(records: DataFrame) -> DataFrame:
    """Per algorithm: records, and how often each score before was at most, or above, the one after.

    ``records``: training records with an ``algorithm`` column.
    """
    metrics = {"mae": "mean_absolute_error", "mse": "mean_squared_error",
               "medae": "median_absolute_error", "r2": "r2_score"}
    counts = []
    for name, column in metrics.items():
        before, after = F.get(column, F.lit(0)), F.get(column, F.lit(1))
        counts.append(F.count_if(before <= after).alias(f"{name}_before_lte_after"))
        counts.append(F.count_if(~(before <= after)).alias(f"{name}_before_gt_after"))
    return records.groupBy("algorithm").agg(F.count(F.lit(1)).alias("n_records"), *counts)


def imputation_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("algorithm", F.coalesce("imputation_strategy", F.lit("none"))
                           .alias("imputation_strategy")).agg(F.count(F.lit(1)).alias("n"))
