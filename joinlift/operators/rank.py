"""Rankings of candidates per query and the measures of their quality."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinlift.functions import attach, deal, materialise, positions, spread
from joinlift.operators.assoc import kendall, kendall_in_tasks
from joinlift.operators.labels import QUERY

K_MAX = 50   # fixed value: the published curves run from k = 0 to 50
EULER = 0.57721566490153286061
HARMONIC = [math.fsum(1 / i for i in range(1, k + 1)) for k in range(32)]   # above, a series is exact to rounding


def _named(group: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group])


def _small(rows: DataFrame, group: Sequence[str], kw: Mapping) -> bool:
    limit = kw.get("split_rows")
    return not spread.has_large_group(rows, group, spread.SPLIT_ROWS if limit is None else limit)


def harmonic(k: Column) -> Column:
    """1 + 1/2 + ... + 1/k; 0 for 0."""
    x = k.cast("double")
    series = F.ln(x) + EULER + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x) - 1 / (252 * F.pow(x, F.lit(6)))
    return F.when(k < len(HARMONIC), F.get(F.array(*[F.lit(h) for h in HARMONIC]), k.cast("int"))).otherwise(series)


def rank_by(rows: DataFrame, score: str, out: str, group: Sequence[str] = QUERY, **kw) -> DataFrame:
    """1-based rank by falling score, ties by candidate; plus ``<out>_total``."""
    marked = rows.withColumn("__neg", -F.col(score))
    return positions(marked, group, ["__neg", "candidate_id"], pos=out, **kw).withColumn(
        out, F.col(out) + 1).drop("__neg")


def rank_candidates(rows: DataFrame, scores: Mapping[str, str],
                    group: Sequence[str] = QUERY, **kw) -> DataFrame:
    """A rank column per entry of ``scores`` (rank name -> score column) and the list length n.

    The source is read once. Behind one count of the groups all rankings share a shuffle, whose tasks follow the rows.
    """
    rows = materialise(rows)
    if _small(rows, group, kw):
        w = Window.partitionBy(*group)
        return deal(rows, group).select(
            "*", *[F.row_number().over(w.orderBy(-F.col(score), "candidate_id")).cast("long").alias(name)
                   for name, score in scores.items()],
            F.count(F.lit(1)).over(w).alias("n"))
    out = rows
    for name, score in scores.items():
        out = rank_by(out, score, name, group, **kw).withColumnRenamed(f"{name}_total", "n")
        if name != list(scores)[-1]:
            out = out.drop("n")
    return out


def ndcg(ranked: DataFrame, k: int = 5, gain: str | None = None, pred: str = "pred_rank",
         real: str = "real_rank", standard: bool = False,
         group: Sequence[str] = QUERY) -> DataFrame:
    """nDCG. Relevance is k, k-1, ... by real rank (or the positive real gain).

    By default only the real ranking is cut at k; ``standard`` also cuts the predicted one.
    """
    length = F.least(F.lit(k), F.col("n"))
    rel = (F.greatest(F.col(gain), F.lit(0.0)) if gain
           else (length - F.col(real) + 1).cast("double"))
    rel = F.when(F.col(real) <= k, rel).otherwise(0.0)
    gained = rel / F.log2(F.col(pred) + 1)
    if standard:
        gained = F.when(F.col(pred) <= k, gained).otherwise(0.0)
    best = F.sum(rel / F.log2(F.col(real) + 1))
    return ranked.groupBy(*group).agg(
        (F.sum(gained) / F.nullif(best, F.lit(0.0))).alias("ndcg"))


def reciprocal_rank(ranked: DataFrame, pred: str = "pred_rank", real: str = "real_rank",
                    group: Sequence[str] = QUERY) -> DataFrame:
    """1 / predicted rank of the really best candidate; its mean over queries is the MRR."""
    return ranked.groupBy(*group).agg(
        F.coalesce(F.max(F.when(F.col(real) == 1, 1 / F.col(pred))), F.lit(0.0))
        .alias("reciprocal_rank"))


def precision_at(ranked: DataFrame, k: int, pred: str = "pred_rank", real: str = "real_rank",
                 group: Sequence[str] = QUERY) -> DataFrame:
    """Share of the real top k among the predicted top k (over k, even for shorter lists)."""
    return ranked.groupBy(*group).agg(
        (F.count_if((F.col(real) <= k) & (F.col(pred) <= k)) / k).alias("precision_at_k"))


def r_precision(ranked: DataFrame, gain: str = "gain", pred: str = "pred_rank",
                group: Sequence[str] = QUERY, positives: str | None = None) -> DataFrame:
    """Share of the R truly positive candidates among the predicted top R; null when R = 0. ``positives`` names R where rows have it."""
    if positives is None:
        sizes = ranked.groupBy(*group).agg(F.count_if(F.col(gain) > 0).alias("r"))
        met, positives = attach(ranked, sizes, group, ["candidate_id"]), "r"
    else:
        met = ranked
    return met.groupBy(*group).agg(
        (F.count_if((F.col(gain) > 0) & (F.col(pred) <= F.col(positives)))
         / F.nullif(F.max(positives), F.lit(0))).alias("r_precision"))


def average_precision(ranked: DataFrame, pred: str = "pred_rank", real: str = "real_rank",
                      group: Sequence[str] = QUERY, **kw) -> DataFrame:
    """Mean of precision@k for k = 1..n; 0 where a group's name has a null.

    A candidate counts from k = max(both ranks) = m on, and adds 1/m + ... + 1/n to the sum over k: a plain aggregate, in no order.
    """
    entered = harmonic(F.greatest(F.col(real), F.col(pred)) - 1)
    mean = harmonic(F.count(F.lit(1))) - F.avg(entered)
    return ranked.groupBy(*group).agg(mean.alias("average_precision")).withColumn(
        "average_precision", F.when(_named(group), F.col("average_precision")).otherwise(F.lit(0.0)))


def kendall_of_rankings(ranked: DataFrame, pred: str = "pred_rank", real: str = "real_rank",
                        group: Sequence[str] = QUERY, **kw) -> DataFrame:
    """Kendall tau between the two rankings of each query; null for a single candidate."""
    joint = materialise(ranked.select(*group, F.col(real).alias("x"), F.col(pred).alias("y"),
                                      F.lit(1).cast("long").alias("c")))
    tau = kendall(joint, list(group), **kw)
    sizes = joint.groupBy(*group).agg(F.count(F.lit(1)).alias("m"))
    return tau.join(sizes, list(group)).select(
        *group, F.when(F.col("m") > 1, F.col("kendall")).alias("kendall_tau"))


def curve_recipes(positive: str = "gain") -> dict[str, tuple[Column, str]]:
    """The eight ways to retrieve candidates: which rows take part, and what orders them."""
    said = F.col("pred_class") == positive
    sure = said & (F.col("p_gain") > 0.6)
    anyone = F.lit(True)
    return {
        "classifier_regressor": (said, "predicted_gain"),
        "certain_regressor": (sure, "predicted_gain"),
        "classifier_containment": (said, "containment"),
        "certain_containment": (sure, "containment"),
        "classifier_pearson": (said, "pearson_difference"),
        "certain_pearson": (sure, "pearson_difference"),
        "containment": (anyone, "containment"),
        "regressor": (anyone, "predicted_gain"),
    }


def _sizes(truly: Column, gain: str, recipes: Mapping[str, tuple[Column, str]]) -> list[Column]:
    said, sure = recipes["classifier_regressor"][0], recipes["certain_regressor"][0]
    return [F.count_if(truly).alias("n_pos"), F.count_if(truly & (F.col(gain) > 1)).alias("n_over1"),
            F.count_if(said).alias("n_said"), F.count_if(sure).alias("n_sure")]


def _entries(hit: Column, rr: Column, pr: Column, gain: Column, k_max: int) -> list[tuple[str, Column]]:
    """The ranks that count, as lists; collect_list skips nulls, and ranks are distinct, so at most k_max entries are gathered."""
    meets = F.greatest(rr, pr)

    def kept(condition, at):
        return F.collect_list(F.when(condition & (at <= k_max), at))
    return [("hits", kept(hit, pr)), ("over1", kept(hit & (gain > 1), meets)), ("over0", kept(hit & (gain > 0), meets))]


def _lists_in_place(rows: DataFrame, recipes: Mapping[str, tuple[Column, str]], gain: str, truly: Column, group: list[str],
                    k_max: int, **kw) -> DataFrame:
    """A row per group and recipe, for groups that fit a task: all rankings share a shuffle, and no row is repeated per recipe."""
    w = Window.partitionBy(*group)

    def rank_among(takes, score):
        return F.row_number().over(w.orderBy(F.when(takes, 0).otherwise(1), -F.col(score).cast("double"), "candidate_id")).cast("long")
    own = truly & F.col("candidate_id").isNotNull()
    placed = deal(rows.where(_named(group)), group).select(
        "*", F.when(own, rank_among(truly, gain)).alias("rr"),
        *[F.when(takes, rank_among(takes, score)).alias(f"pr_{n}") for n, (takes, score) in recipes.items()])
    per = placed.groupBy(*group).agg(*_sizes(truly, gain, recipes), *[c.alias(f"{part}_{n}") for n in recipes for part, c in [
        ("n", F.count(f"pr_{n}")), *_entries(F.col("rr").isNotNull() & F.col(f"pr_{n}").isNotNull(), F.col("rr"), F.col(f"pr_{n}"), F.col(gain), k_max)]])
    each = F.array(*[F.struct(F.lit(n).alias("recipe"), F.col(f"n_{n}").alias("n_ret"), *[
        F.col(f"{part}_{n}").alias(part) for part in ("hits", "over1", "over0")]) for n in recipes])
    return per.where("n_pos > 0 and n_said > 0 and n_sure > 0").select(*group, "n_pos", "n_over1", F.inline(each))


def _lists_in_ranges(rows: DataFrame, recipes: Mapping[str, tuple[Column, str]], gain: str, truly: Column, group: list[str],
                     k_max: int, **kw) -> DataFrame:
    """The same for groups of any size."""
    sizes = rows.groupBy(*group).agg(*_sizes(truly, gain, recipes))
    sizes = sizes.where("n_pos > 0 and n_said > 0 and n_sure > 0")
    real = rank_by(rows.where(truly), gain, "rr", group, **kw).select(*group, "candidate_id", "rr")
    base = rows.join(real, [*group, "candidate_id"], "left")
    entries = F.filter(F.array(*[
        F.when(takes, F.struct(F.lit(n).alias("recipe"), F.col(s).cast("double").alias("score")))
        for n, (takes, s) in recipes.items()]), lambda e: e.isNotNull())
    each = base.withColumn("e", F.explode(entries)).select(
        *group, "candidate_id", F.col(gain).alias("g"), "rr", "e.recipe", "e.score")
    placed = rank_by(each, "score", "pr", [*group, "recipe"], **kw)
    lists = placed.groupBy(*group, "recipe").agg(F.max("pr_total").alias("n_ret"), *[
        c.alias(part) for part, c in _entries(F.col("rr").isNotNull(), F.col("rr"), F.col("pr"), F.col("g"), k_max)])
    return lists.join(sizes, group)


def retrieval_curves(rows: DataFrame, gain: str = "gain", label: str = "class",
                     positive: str = "gain", group: Sequence[str] = QUERY,
                     k_max: int = K_MAX, **kw) -> DataFrame:
    """Precision, recall, strict R-precision and R-recall at k = 0..k_max for every recipe.

    Queries without a true, a predicted and a certain positive are left out. Averages run over the
    queries for which a measure is defined.
    """
    group = list(group)
    recipes = curve_recipes(positive)
    needed = dict.fromkeys([*group, "candidate_id", gain, label, "pred_class", "p_gain", *[score for _, score in recipes.values()]])
    rows = materialise(rows.select(*needed))
    lists = (_lists_in_place if _small(rows, group, kw) else _lists_in_ranges)(
        rows, recipes, gain, F.col(label) == positive, group, k_max, **kw)
    per_k = lists.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k_max))))
    def up_to(arr, k):
        return F.size(F.filter(arr, lambda r: r <= k))
    k = F.col("k")
    m = F.least(k.cast("long"), "n_over1")
    got = F.least(k.cast("long"), "n_ret")
    def ratio(a, b):
        return a / F.nullif(b, F.lit(0))
    found = per_k.select(
        *group, "recipe", "k",
        ratio(up_to("hits", k), got).alias("precision"),
        F.when(got > 0, up_to("hits", k) / F.col("n_pos")).alias("recall"),
        ratio(up_to("over1", m), F.least(m, "n_ret")).alias("strict_r_precision"),
        ratio(up_to("over0", k), got).alias("r_recall"))
    return found.groupBy("recipe", "k").agg(*[
        F.avg(c).alias(c) for c in ("precision", "recall", "strict_r_precision", "r_recall")],
        F.count(F.lit(1)).alias("n_queries"))


def ranking_report(rows: DataFrame, scores: Mapping[str, str], gain: str = "gain",
                   group: Sequence[str] = QUERY, **kw) -> DataFrame:
    """Averages over queries for the model and its baselines, one row per entry of ``scores``.

    Kendall tau and R-precision are averaged over the queries where they exist for all rankings.
    """
    group = list(group)
    needed = dict.fromkeys([*group, "candidate_id", gain, *scores.values()])
    rows = materialise(rows.select(*needed))
    places = {name: f"__rank_{i}" for i, name in enumerate(scores)}
    ranked = rank_candidates(rows, {"real_rank": gain, **{places[name]: score for name, score in scores.items()}}, group, **kw)
    small = _small(rows, group, kw)
    if small:
        ranked = ranked.withColumn("__r", F.count_if(F.col(gain) > 0).over(Window.partitionBy(*group)))
    wide = materialise(ranked.where(_named(group)).select(*group, "candidate_id", F.col(gain).alias("__gain"), "real_rank", "n", *places.values(),
                                                          *(["__r"] if small else [])))
    # one list per (ranking, query), so that every measure below is computed once for all
    each = wide.drop(*places.values()).columns
    ranked = wide.select(*each, F.inline(F.array(*[
        F.struct(F.lit(name).alias("ranking"), F.col(at).alias("pred_rank")) for name, at in places.items()])))
    lists = ["ranking", *group]
    if small:
        taus = kendall_in_tasks(wide, group, {name: ("real_rank", at) for name, at in places.items()})
        tau = taus.select(*group, F.inline(F.array(*[
            F.struct(F.lit(name).alias("ranking"), F.col(f"`{name}`").alias("kendall_tau")) for name in places])))
        sizes = wide.groupBy(*group).agg(F.count(F.lit(1)).alias("__m"))
        tau = tau.join(sizes, group).select(*lists, F.when(F.col("__m") > 1, F.col("kendall_tau")).alias("kendall_tau"))
    else:
        ranked = materialise(ranked)
        tau = kendall_of_rankings(ranked, group=lists, **kw)
    simple = ranked.groupBy(*lists).agg(
        F.count_if((F.col("real_rank") <= 1) & (F.col("pred_rank") <= 1)).cast("double")
        .alias("precision_at_1"))
    everything = (
        simple.join(precision_at(ranked, 5, group=lists)
                    .withColumnRenamed("precision_at_k", "precision_at_5"), lists)
        .join(average_precision(ranked, group=lists, **kw), lists)
        .join(ndcg(ranked, group=lists), lists)
        .join(r_precision(ranked, "__gain", group=lists, positives="__r" if small else None), lists)
        .join(tau, lists))
    everything = materialise(everything)
    whole = everything.groupBy(*group).agg(
        F.count("kendall_tau").alias("kt"), F.count("r_precision").alias("rp"))
    met = everything.join(whole, group)
    full = F.lit(len(scores))
    return met.groupBy("ranking").agg(
        F.avg(F.when(F.col("kt") == full, F.col("kendall_tau"))).alias("kendall_tau"),
        F.avg("precision_at_1").alias("precision_at_1"),
        F.avg("precision_at_5").alias("precision_at_5"),
        F.avg(F.when(F.col("rp") == full, F.col("r_precision"))).alias("r_precision"),
        F.avg("average_precision").alias("map"),
        F.avg("ndcg").alias("ndcg"),
        F.count(F.lit(1)).alias("n_queries"))
