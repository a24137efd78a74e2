"""Pruners: which candidates of each query survive, and with what score."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlift.functions import materialise, positions
from joinlift.operators import joins
from joinlift.operators.labels import QUERY
from joinlift.operators.splits import random_share
from joinlift.schema import PAIR


def rank_pairs(scored: DataFrame, scores: Sequence[str], **kw) -> DataFrame:
    """1-based ``rank`` within the query by falling scores, ties by candidate."""
    marked = scored.withColumns({f"__neg_{s}": -F.col(s) for s in scores})
    placed = positions(marked, QUERY, [*[f"__neg_{s}" for s in scores], "candidate_id"],
                       pos="rank", **kw)
    return placed.withColumn("rank", F.col("rank") + 1).drop(
        "rank_total", *[f"__neg_{s}" for s in scores])


def ranked_by_containment(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    met = joins.containment(pairs, cells).select("query_id", "candidate_id", "containment")
    return pairs.select(*PAIR).join(met, ["query_id", "candidate_id"])


def keep_best(scored: DataFrame, score: str, n: int | None = None, share: float | None = None,
              min_score: float | None = None, **kw) -> DataFrame:
    """The ``n`` best of each query (or the share ``int(share * count)``), then those over ``min_score``."""
    marked = scored.withColumn("__neg", -F.col(score))
    placed = positions(marked, QUERY, ["__neg", "candidate_id"], pos="rank", **kw)
    limit = F.lit(n) if n is not None else (
        F.floor(F.col("rank_total") * share) if share is not None else F.col("rank_total"))
    kept = placed.where(F.col("rank") < limit).withColumn("rank", F.col("rank") + 1)
    if min_score is not None:
        kept = kept.where(F.col(score) > min_score)
    return kept.drop("rank_total", "__neg")


def by_containment(pairs: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    return keep_best(ranked_by_containment(pairs, cells), "containment", n=n)


def keep_root(ranked: DataFrame, score: str = "containment", **kw) -> DataFrame:
    """The floor(sqrt(count)) best of each query."""
    marked = ranked.withColumn("__neg", -F.col(score))
    placed = positions(marked, QUERY, ["__neg", "candidate_id"], pos="rank", **kw)
    return placed.where(F.col("rank") < F.floor(F.sqrt("rank_total"))).drop(
        "rank", "rank_total", "__neg")


def by_threshold(ranked: DataFrame, score: str = "containment", theta: float = 0.6) -> DataFrame:
    return ranked.where(F.col(score) >= theta)


def unpruned(pairs: DataFrame) -> DataFrame:
    return pairs.select(*PAIR)


def at_random(pairs: DataFrame, pruned_share: float, seed: str = "random") -> DataFrame:
    """Drop ``pruned_share`` of each query's candidates in md5 order."""
    return random_share(pairs.select(*PAIR), 1.0 - pruned_share, QUERY, seed)


def by_model(instances: DataFrame, score: Callable[[DataFrame], DataFrame], *, n: int | None = None,
             share: float | None = None, min_score: float = 0.5) -> DataFrame:
    """Score feature vectors with a trained metamodel and keep the best.

    ``score`` adds the column ``score``: p(gain) of a classifier or the gain of a regressor.
    """
    return keep_best(score(instances), "score", n=n, share=share, min_score=min_score)


def in_two_steps(pairs: DataFrame, free_features: Callable[[DataFrame], DataFrame],
                 all_features: Callable[[DataFrame], DataFrame],
                 first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame],
                 *, n: int | None = None, pruned_share: float | None = None,
                 min_score: float | None = 0.5, early_exit: bool = False) -> DataFrame:
    """Prune on features that need no join; join and score only what is left.

    ``early_exit``: a query that the first model has already pruned enough stops there;
    the second model decides for all others.
    """
    free = first(free_features(pairs))
    survivors = free.where(F.col("score") > 0.5).select(*PAIR, F.col("score").alias("first_score"))
    done = None
    if early_exit:
        survivors = materialise(survivors)
        kept = survivors.groupBy(*QUERY).agg(F.count(F.lit(1)).alias("__kept"))
        total = pairs.groupBy(*QUERY).agg(F.count(F.lit(1)).alias("__total"))
        enough = materialise(total.join(kept, QUERY).where(
            F.col("__kept") <= F.col("__total") * (1.0 - (pruned_share or 0.0))).select(*QUERY))
        done = survivors.join(enough, QUERY, "left_semi").select(*PAIR, F.col("first_score").alias("score"))
        survivors = survivors.join(enough, QUERY, "left_anti")
    left = pairs.join(survivors.select(*PAIR), PAIR, "left_semi")
    scored = second(all_features(left))
    share = None if pruned_share is None else 1.0 - pruned_share
    best = keep_best(scored, "score", n=n, share=share, min_score=min_score)
    return best if done is None else best.unionByName(done, allowMissingColumns=True)


def containment_then_model(pairs: DataFrame, cells: DataFrame,
                           all_features: Callable[[DataFrame], DataFrame],
                           score: Callable[[DataFrame], DataFrame], n: int,
                           min_score: float = 0.5) -> DataFrame:
    """The n*n best by containment, of these the n best by model."""
    short = by_containment(pairs, cells, n * n).select(*PAIR)
    return by_model(all_features(short), score, n=n, min_score=min_score)


def pruning_power(survivors: DataFrame, relevant: DataFrame) -> DataFrame:
    """Share of the known relevant candidates that survived, per query."""
    known = relevant.select(*PAIR).distinct()
    hit = survivors.select(*PAIR).distinct().withColumn("__hit", F.lit(1))
    return known.join(hit, PAIR, "left").groupBy(*QUERY).agg(
        F.count(F.lit(1)).alias("n_relevant"), F.count("__hit").alias("n_kept")).withColumn(
        "power", F.col("n_kept") / F.col("n_relevant"))
