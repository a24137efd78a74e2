"""Imputation, scaling and outlier filters, per group and without whole-group windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlift.functions import attach, finite, group_median, with_one_row

MAD_TO_SD = 1.4826   # fixed value: scales the median absolute deviation to a standard deviation


def _meet(rows: DataFrame, stats: DataFrame, group: Sequence[str], spread: Sequence[str]):
    """Put group statistics on the rows; without a group the statistics are one row."""
    if not group:
        return with_one_row(rows, stats)
    return attach(rows, stats, group, spread)


def fill_value(rows: DataFrame, group: Sequence[str], value: str, strategy: str) -> DataFrame:
    """The value that replaces a missing one: mean, median or most frequent (smallest on ties)."""
    if strategy == "mean":
        return rows.groupBy(*group).agg(F.avg(value).alias("fill"))
    if strategy == "median":
        return group_median(rows, group, value, "fill")
    if strategy == "most_frequent":
        counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(
            F.count(F.lit(1)).alias("__c"))
        return counts.groupBy(*group).agg(
            F.min_by(value, F.struct(-F.col("__c"), F.col(value))).alias("fill"))
    raise ValueError(f"unknown strategy {strategy!r}")


def impute(rows: DataFrame, group: Sequence[str], value: str, spread: Sequence[str],
           strategy: str = "mean", empty: float = 0.0) -> DataFrame:
    """Replace missing, NaN and infinite values; a group without any value becomes ``empty``."""
    clean = rows.withColumn(value, finite(F.col(value).cast("double")))
    fills = fill_value(clean, group, value, strategy)
    return _meet(clean, fills, group, spread).withColumn(
        value, F.coalesce(value, "fill", F.lit(empty))).drop("fill")


def best_strategy(scores: DataFrame, group: Sequence[str]) -> DataFrame:
    """The imputation with the lowest error per group, from ``(group, strategy, mae)``."""
    return scores.groupBy(*group).agg(
        F.min_by("strategy", F.struct("mae", "strategy")).alias("strategy"),
        F.min("mae").alias("mae"))


def standardise(rows: DataFrame, group: Sequence[str], values: Sequence[str],
                spread: Sequence[str], fit_on=None) -> DataFrame:
    """(v - mean) / population deviation, fitted where ``fit_on`` holds; constants become 0."""
    fitted = rows if fit_on is None else rows.where(fit_on)
    stats = fitted.groupBy(*group).agg(
        *[F.avg(v).alias(f"__m_{v}") for v in values],
        *[F.stddev_pop(v).alias(f"__s_{v}") for v in values])
    met = _meet(rows, stats, group, spread)
    for v in values:
        sd = F.when(F.col(f"__s_{v}") == 0, 1.0).otherwise(F.col(f"__s_{v}"))
        met = met.withColumn(v, (F.col(v) - F.col(f"__m_{v}")) / sd)
    return met.drop(*[f"__{p}_{v}" for p in "ms" for v in values])


def min_max(rows: DataFrame, group: Sequence[str], values: Sequence[str],
            spread: Sequence[str]) -> DataFrame:
    """(v - min) / (max - min); constants become 0."""
    stats = rows.groupBy(*group).agg(*[F.min(v).alias(f"__a_{v}") for v in values],
                                     *[F.max(v).alias(f"__b_{v}") for v in values])
    met = _meet(rows, stats, group, spread)
    for v in values:
        width = F.col(f"__b_{v}") - F.col(f"__a_{v}")
        met = met.withColumn(v, (F.col(v) - F.col(f"__a_{v}"))
                             / F.when(width == 0, 1.0).otherwise(width))
    return met.drop(*[f"__{p}_{v}" for p in "ab" for v in values])


def divide_by_max(rows: DataFrame, group: Sequence[str], value: str, spread: Sequence[str],
                  absolute: bool = False) -> DataFrame:
    top = F.max(F.abs(value)) if absolute else F.max(value)
    stats = rows.groupBy(*group).agg(top.alias("__top"))
    return _meet(rows, stats, group, spread).withColumn(
        value, F.col(value) / F.nullif(F.col("__top"), F.lit(0.0))).drop("__top")


def drop_z_outliers(rows: DataFrame, values: Sequence[str], threshold: float = 3.0,
                    group: Sequence[str] = (), spread: Sequence[str] = ()) -> DataFrame:
    """Keep rows whose every listed value lies within ``threshold`` population deviations."""
    stats = rows.groupBy(*group).agg(
        *[F.avg(v).alias(f"__m_{v}") for v in values],
        *[F.stddev_pop(v).alias(f"__s_{v}") for v in values])
    met = _meet(rows, stats, group, spread)
    for v in values:
        z = (F.col(v) - F.col(f"__m_{v}")) / F.nullif(F.col(f"__s_{v}"), F.lit(0.0))
        met = met.where(F.abs(z) <= threshold)
    return met.drop(*[f"__{p}_{v}" for p in "ms" for v in values])


def drop_mad_outliers(rows: DataFrame, value: str, kind: str = "median",
                      threshold: float | None = None, group: Sequence[str] = (),
                      spread: Sequence[str] = ()) -> DataFrame:
    """Keep rows within ``threshold`` deviations of the median.

    ``median``: scaled median absolute deviation about the median, threshold 2.
    ``mean``: mean absolute deviation about the mean, threshold 3; distance is still from the median.
    """
    if kind not in ("median", "mean"):
        raise ValueError(f"unknown deviation {kind!r}")
    limit = threshold if threshold is not None else (2.0 if kind == "median" else 3.0)
    met = _meet(rows, group_median(rows, group, value, "__median"), group, spread)
    if kind == "median":
        away = met.select(*group, F.abs(F.col(value) - F.col("__median")).alias("__away"))
        scale = group_median(away, group, "__away", "__mad").withColumn(
            "__mad", F.col("__mad") * MAD_TO_SD)
    else:
        means = rows.groupBy(*group).agg(F.avg(value).alias("__mean"))
        away = _meet(rows, means, group, spread)
        scale = away.groupBy(*group).agg(
            F.avg(F.abs(F.col(value) - F.col("__mean"))).alias("__mad"))
    met = _meet(met, scale, group, spread)
    return met.where(
        F.abs(F.col(value) - F.col("__median")) / F.nullif(F.col("__mad"), F.lit(0.0)) < limit
    ).drop("__median", "__mad")


def keep_small(rows: DataFrame, value: str, threshold: float = 0.1) -> DataFrame:
    return rows.where(F.abs(value) <= threshold)


def keep_large(rows: DataFrame, value: str, threshold: float = 10.0) -> DataFrame:
    return rows.where(F.abs(value) > threshold)
