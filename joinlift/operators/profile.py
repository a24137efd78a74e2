"""Column profiles and the per-dataset feature vector, over the whole lake at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinlift.functions import (
    attach, max_modulus, unbiased_kurtosis, unbiased_skewness, with_one_row,
)
from joinlift.schema import PROFILE_FEATURES

OUTLIER_Z = 3.0
COLUMN = ["dataset_id", "col"]


def value_counts(cells: DataFrame) -> DataFrame:
    """One row per distinct value of a column: the pre-aggregation other steps share."""
    return cells.groupBy(*COLUMN, "v").agg(F.count(F.lit(1)).alias("c"))


def moments(cells: DataFrame) -> DataFrame:
    """Mean, deviations, bias-corrected skewness and kurtosis, missing share per column."""
    v, n = F.col("v"), F.count("v")
    return cells.groupBy(*COLUMN).agg(
        F.count(F.lit(1)).alias("n_rows"),
        n.alias("n_values"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("sd"),
        unbiased_skewness(v, n).alias("skewness"),
        unbiased_kurtosis(v, n).alias("kurtosis"),
        (1 - n / F.count(F.lit(1))).alias("missing_share"))


def profile(cells: DataFrame, *, approximate_distinct: bool = False) -> DataFrame:
    """Every per-column statistic. Two passes: outliers need the mean and deviation first.

    A column with nulls or without spread has outlier share 0.
    """
    base = moments(cells)
    limits = base.select(*COLUMN, "mean", "sd", "n_rows", "n_values")
    z = (F.col("v") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    clean = F.col("n_rows") == F.col("n_values")
    counted = attach(value_counts(cells), limits, COLUMN, ["v"], how="inner").groupBy(*COLUMN).agg(
        F.count("v").alias("n_distinct"),
        F.sum(F.when(clean & (F.abs(z) > OUTLIER_Z), F.col("c")).otherwise(0)).alias("n_outliers"))
    if approximate_distinct:
        sketch = cells.groupBy(*COLUMN).agg(F.approx_count_distinct("v").alias("n_distinct"))
        counted = counted.drop("n_distinct").join(sketch, COLUMN)
    return base.join(counted, COLUMN).withColumn(
        "outlier_share", F.col("n_outliers") / F.col("n_rows")).drop("n_outliers")


def dataset_features(column_profile: DataFrame) -> DataFrame:
    """The 8 profile features per dataset; each keeps its largest absolute value."""
    return column_profile.groupBy("dataset_id").agg(
        F.count(F.lit(1)).cast("double").alias("num_of_columns"),
        F.max("n_rows").cast("double").alias("num_of_rows"),
        (F.max("n_rows") / F.count(F.lit(1))).alias("row_column_ratio"),
        max_modulus(F.col("mean")).alias("max_mean"),
        max_modulus(F.col("outlier_share")).alias("max_outlier_percentage"),
        max_modulus(F.col("skewness")).alias("max_skewness"),
        max_modulus(F.col("kurtosis")).alias("max_kurtosis"),
        max_modulus(F.col("n_distinct")).cast("double").alias("max_unique"),
    ).select("dataset_id", *PROFILE_FEATURES)


def dataset_sizes(cells: DataFrame, columns_meta: DataFrame | None = None) -> DataFrame:
    """Rows, columns, numeric columns and their ratio per dataset.

    ``columns_meta`` adds the columns that did not become cells (text, flags).
    """
    per_col = cells.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("n"))
    sizes = per_col.groupBy("dataset_id").agg(
        F.max("n").alias("n_rows"), F.count(F.lit(1)).alias("n_numeric_columns"))
    if columns_meta is None:
        sizes = sizes.withColumn("n_columns", F.col("n_numeric_columns"))
    else:
        named = columns_meta.select("dataset_id", "col").distinct().groupBy("dataset_id").agg(
            F.count(F.lit(1)).alias("n_columns"))
        sizes = sizes.join(named, "dataset_id")
    return sizes.withColumn("row_column_ratio", F.col("n_rows") / F.col("n_columns"))


def source_sizes(lines: DataFrame) -> DataFrame:
    """Rows and bytes of each source file, from its text lines ``(dataset_id, line)``."""
    return lines.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.octet_length("line") + 1).alias("n_bytes"))


def histogram(rows: DataFrame, group: list[str], value: str, bins: int,
              low: Column | float | None = None, high: Column | float | None = None) -> DataFrame:
    """Equal-width histogram with counts and shares; the last bin is closed on the right.

    Without ``low``/``high`` the range is each group's own minimum and maximum.
    """
    v = F.col(value).cast("double")
    clean = rows.where(v.isNotNull()).select(*group, v.alias("__v"))
    # equal values meet in one row before they meet the range
    counted = clean.groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__c"))
    if low is None or high is None:
        ends = clean.groupBy(*group).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        counted = (attach(counted, ends, group, ["__v"], how="inner") if group
                   else with_one_row(counted, ends))
    else:
        counted = counted.withColumns({"__lo": F.lit(low).cast("double"),
                                       "__hi": F.lit(high).cast("double")})
        counted = counted.where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
    width = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    place = F.floor((F.col("__v") - F.col("__lo")) / width * bins) + 1
    place = F.coalesce(F.least(place, F.lit(bins)), F.lit(1)).cast("long")
    filled = counted.groupBy(*group, place.alias("bin")).agg(F.sum("__c").alias("n"))
    totals = filled.groupBy(*group).agg(F.sum("n").alias("__t"))
    joined = filled.join(totals, group) if group else with_one_row(filled, totals)
    return joined.select(*group, "bin", "n", (F.col("n") / F.col("__t")).alias("share"))


def class_balance(rows: DataFrame, thetas: list[float], theta_of: str, label: str,
                  positive: str = "gain") -> DataFrame:
    """Rows, classes and success share of each version ``theta_of >= theta``."""
    ladder = versions_by_threshold(rows, thetas, theta_of)
    return ladder.groupBy("theta").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == positive).alias("n_positive"),
        F.count_if(F.col(label) != positive).alias("n_negative")).withColumn(
        "success_share", F.col("n_positive") / F.col("n"))


def versions_by_threshold(rows: DataFrame, thetas: list[float], theta_of: str) -> DataFrame:
    """Each row once per threshold it reaches (a literal list, so no join is needed)."""
    ladder = F.array(*[F.lit(float(t)) for t in thetas])
    reached = F.filter(ladder, lambda t: F.col(theta_of) >= t)
    return rows.withColumn("theta", F.explode(reached))
