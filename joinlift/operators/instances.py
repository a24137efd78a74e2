"""Feature vectors of (query, target, candidate) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlift.functions import materialise
from joinlift.operators import assoc, joins, profile
from joinlift.schema import (
    ALL_FEATURES, ASSOCIATION_FEATURES, CANDIDATE_FEATURES, CONTAINMENT, PAIR, PEARSON_DIFFERENCE, PROFILE_FEATURES,
    QUERY_FEATURES,
)


def profile_features(pairs: DataFrame, cells: DataFrame, include_target: bool = True) -> DataFrame:
    """The 16 profile features; every dataset is profiled once, however many pairs name it.

    ``include_target=False`` leaves a query's target out of its own profile.
    """
    used = pairs.select(F.col("query_id").alias("dataset_id")).union(
        pairs.select(F.col("candidate_id").alias("dataset_id"))).distinct()
    columns = profile.profile(cells.join(used, "dataset_id", "left_semi"))
    if include_target:
        vectors = materialise(profile.dataset_features(columns))
        q_keys, q_vectors = ["query_id"], vectors.withColumnRenamed("dataset_id", "query_id")
    else:
        columns = materialise(columns)
        vectors = profile.dataset_features(columns)
        q_keys = ["query_id", "target"]
        own = pairs.select(*q_keys).distinct().join(
            columns.withColumnRenamed("dataset_id", "query_id"), "query_id").where(
            F.col("col") != F.col("target"))
        tagged = own.withColumn("dataset_id", F.struct("query_id", "target"))
        q_vectors = profile.dataset_features(tagged).select("dataset_id.*", *PROFILE_FEATURES)
    q = q_vectors.select(*q_keys, *[F.col(f).alias(n) for f, n in zip(PROFILE_FEATURES,
                                                                        QUERY_FEATURES)])
    c = vectors.select(F.col("dataset_id").alias("candidate_id"), *[
        F.col(f).alias(n) for f, n in zip(PROFILE_FEATURES, CANDIDATE_FEATURES)])
    return pairs.select(*PAIR).join(q, q_keys).join(c, "candidate_id")


def query_target_features(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """The 4 association features of a query's own columns with its target; needs no join."""
    rows = assoc.aligned(assoc.own_pairs(queries), cells, impute=None)
    return _query_side(queries, assoc.strongest(assoc.measures(rows)))


def _query_side(queries: DataFrame, strongest: DataFrame) -> DataFrame:
    named = strongest.select("query_id", "target", *[
        F.col(f).alias(f"query_target_{f}") for f in ASSOCIATION_FEATURES])
    everyone = queries.select("query_id", "target").distinct()
    return everyone.join(named, ["query_id", "target"], "left").na.fill(0.0)


def pair_features(pairs: DataFrame, cells: DataFrame, impute: str | None = "mean") -> DataFrame:
    """The 10 features of the join: query-target, candidate-target, their difference, containment.

    Mean-filled columns are measured from the matched rows alone (``assoc.match``).
    """
    own = assoc.own_pairs(pairs)
    if impute == "mean":
        others = assoc.matched_measures(assoc.match(pairs, cells))
        measured = others.unionByName(assoc.measures(assoc.aligned(own, cells, impute=None)))
    else:
        measured = assoc.measures(assoc.aligned(pairs, cells, impute=impute).unionByName(assoc.aligned(own, cells, impute=None)))
    strongest = materialise(assoc.strongest(measured))
    is_own = F.col("query_id") == F.col("candidate_id")
    q = _query_side(pairs, strongest.where(is_own))
    c = strongest.where(~is_own).select(*PAIR, *[
        F.col(f).alias(f"candidate_target_{f}") for f in ASSOCIATION_FEATURES])
    inside = joins.containment(pairs, cells).select("query_id", "candidate_id",
                                                    F.col("containment").alias(CONTAINMENT))
    both = pairs.select(*PAIR).join(c, PAIR, "left").na.fill(0.0).join(q, ["query_id", "target"]).join(
        inside, ["query_id", "candidate_id"])
    return both.withColumn(PEARSON_DIFFERENCE, assoc.pearson_difference(
        F.col("candidate_target_max_pearson"), F.col("query_target_max_pearson")))


def free_features(pairs: DataFrame, cells: DataFrame, include_target: bool = True) -> DataFrame:
    """The 20 features known before any candidate is joined."""
    return profile_features(pairs, cells, include_target).join(
        query_target_features(pairs, cells), ["query_id", "target"])


def feature_vectors(pairs: DataFrame, cells: DataFrame, include_target: bool = True,
                    impute: str | None = "mean") -> DataFrame:
    """All 26 features of every pair."""
    return profile_features(pairs, cells, include_target).join(
        pair_features(pairs, cells, impute), PAIR).select(*PAIR, *ALL_FEATURES)
