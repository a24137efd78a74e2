"""Feature selectors on the augmented table that the pruners leave.

A table here is wide: a key column, a numeric target and numeric features. Scores are aggregates
over rows; what reaches the driver is one number per feature or per pair of features.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinlift.functions import average_ranks, hash32, hash_order, materialise, meet, pearson
from joinlift.operators.forests import fit_forests, forest_importances
from joinlift.operators.metamodel import DEPTH, in_fixed_order
from joinlift.operators.products import Products, solve
from joinlift.operators.splits import hold_out

# Shares, thresholds and seeds of the random-injection selector.
RANDOM_PREFIX = "random_feature_"
ETA = 0.2
TAUS = (0.1, 0.2, 0.4, 0.6, 0.8)
SEEDS = (42, 17, 23, 2, 5, 19, 37, 41, 13, 33)
CORRELATION_LIMIT = 0.85
VARIANCE_LIMIT = 0.01
ROUND_ROWS = 8_000_000     # rows of rounds of the shadow selector that share a job


def unpivot(table: DataFrame, key: str, target: str, features: Sequence[str]) -> DataFrame:
    """Wide table to ``(row_key, y, col, x)``."""
    return table.select(F.col(key).cast("string").alias("row_key"),
                        F.col(target).cast("double").alias("y"),
                        *[F.col(f"`{f}`").cast("double").alias(f) for f in features]).unpivot(
        ["row_key", "y"], list(features), "col", "x")


# ---- univariate: the best sqrt(p) ------------------------------------------------------------

def keep_top_root(scored: DataFrame, score: str, group: Sequence[str] = ()) -> DataFrame:
    """The int(sqrt(p)) features of highest score; p counts the features that have one."""
    have = scored.where(F.col(score).isNotNull())
    w = Window.partitionBy(*group)   # one row per feature
    ranked = have.withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), "col"))) \
        .withColumn("p", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("rank") <= F.floor(F.sqrt("p"))).drop("p")


def f_scores(cells: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """F statistic of a simple regression of y on each feature: r^2/(1-r^2) * (n-2)."""
    stats = cells.groupBy(*group, "col").agg(pearson("x", "y").alias("r"),
                                             F.count("x").alias("n"))
    r2 = F.col("r") * F.col("r")
    f = r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2)
    return stats.select(*group, "col", F.when((r2 == 1), F.lit(float("inf"))).otherwise(f)
                        .alias("f"))


def by_f_test(cells: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return keep_top_root(f_scores(cells, group), "f", group)


def by_correlation(cells: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    scored = cells.groupBy(*group, "col").agg(F.abs(pearson("x", "y")).alias("r"))
    return keep_top_root(scored, "r", group)


def binned(cells: DataFrame, bins: int, group: Sequence[str] = (), **kw) -> DataFrame:
    """x and y replaced by equal-count bins; equal values share a bin (by their average rank).

    Bins rise with the value, so the largest value of each says where it ends: a feature's few cuts meet its cells, whose bins
    are looked up. No cell meets another by its value, however frequent that is.
    """
    g = [*group, "col"]
    cells = materialise(cells)
    def cuts_of(side):
        counts = cells.groupBy(*g, side).agg(F.count(F.lit(1)).alias("c"))
        ranks = average_ranks(counts, g, side, "c", f"__r_{side}", "__n", **kw)
        ends = ranks.where(F.col(side).isNotNull()).groupBy(
            *g, F.floor((F.col(f"__r_{side}") - 0.5) * bins / F.col("__n")).alias("b")).agg(F.max(side).alias("end"))
        # at most one cut per bin
        sorted_ = ends.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("end", "b"))).alias("__cuts"))
        return sorted_.select(*g, F.col("__cuts.end").alias(f"__ends_{side}"), F.col("__cuts.b").alias(f"__bins_{side}"))
    cuts = materialise(cuts_of("x").join(cuts_of("y"), g))
    met = meet(cells.where("x is not null and y is not null").select(*g, "x", "y"), cuts, g, ["x", "y"])
    for side in ("x", "y"):
        # a binary search in plain steps, which compile; array functions would run interpreted for every cell
        met = met.withColumn("__at", F.lit(0))
        for step in (2 ** i for i in range(bins.bit_length() - 1, -1, -1)):
            below = F.get(f"__ends_{side}", F.col("__at") + F.lit(step - 1)) < F.col(side)
            met = met.withColumn("__at", F.when(below, F.col("__at") + F.lit(step)).otherwise(F.col("__at")))
        met = met.withColumn(f"b{side}", F.get(f"__bins_{side}", F.col("__at")))
    return met.groupBy(*g, "bx", "by").agg(F.count(F.lit(1)).alias("c"))


def mutual_information(cells: DataFrame, bins: int = 32, group: Sequence[str] = (),
                       **kw) -> DataFrame:
    """Mutual information (in nats) of the binned feature and target."""
    g = [*group, "col"]
    joint = materialise(binned(cells, bins, group, **kw))   # at most bins^2 rows per feature
    x = joint.groupBy(*g, "bx").agg(F.sum("c").alias("cx"))
    y = joint.groupBy(*g, "by").agg(F.sum("c").alias("cy"))
    n = joint.groupBy(*g).agg(F.sum("c").alias("n"))
    met = joint.join(x, [*g, "bx"]).join(y, [*g, "by"]).join(n, g)
    c, total = F.col("c"), F.col("n")
    return met.groupBy(*g).agg(F.sum(
        c / total * F.ln(c * total / (F.col("cx") * F.col("cy")))).alias("mutual_info"))


def by_mutual_information(cells: DataFrame, bins: int = 32, group: Sequence[str] = (),
                          **kw) -> DataFrame:
    return keep_top_root(mutual_information(cells, bins, group, **kw), "mutual_info", group)


def low_variance(cells: DataFrame, limit: float = VARIANCE_LIMIT,
                 group: Sequence[str] = ()) -> DataFrame:
    """Features to drop: population variance at most ``limit``."""
    return cells.groupBy(*group, "col").agg(F.var_pop("x").alias("variance")).where(
        F.col("variance") <= limit)


# ---- sums of products: one pass over the rows ---------------------------------------------------

def _products(table: DataFrame, target: str, features: Sequence[str], by: str | None = None) -> Products:
    """Product matrices of (1, features, target): one per value of ``by``."""
    tag = F.lit(0) if by is None else F.col(by)
    return Products(table.select(tag.cast("int").alias("part"), F.col(target).cast("double").alias("y"),
                                 F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features]).alias("xs")))


def correlated(table: DataFrame, features: Sequence[str], limit: float = CORRELATION_LIMIT) -> list[str]:
    """Features to drop: those correlated above ``limit`` with an earlier feature."""
    found = _products(table.withColumn("__one", F.lit(0.0)), "__one", features).correlated_with_earlier(limit)
    return [features[j] for j in found]


def recursive_elimination(table: DataFrame, target: str, features: Sequence[str],
                          keep: int | None = None) -> list[str]:
    """Drop the feature of smallest |coefficient| of a linear model until half are left."""
    keep = len(features) // 2 if keep is None else keep
    return [features[j] for j in _products(table, target, features).eliminated(keep)]


def forward_stepwise(table: DataFrame, key: str, target: str, features: Sequence[str], k: int = 5,
                     n_folds: int = 5) -> list[str]:
    """Floating forward selection of ``k`` features by cross-validated R2 of a linear model.

    One pass gives a product matrix per fold. A step needs only the lines of the chosen features, which is linear in their number.
    """
    split = table.withColumn("__fold", hash32(key, seed="42") % n_folds)
    products = _products(split, target, features, "__fold")
    last = products.k - 1
    held = {i: {p: line[n] for p, (line, _) in got.items()} for got in [products.lines((0, last))] for n, i in enumerate((0, last))}
    diagonal = {p: d for p, (_, d) in products.lines((0,)).items()}

    def small(p, at):
        """The matrix of (1, chosen and one more, target) of a part, from the lines at hand."""
        def entry(a, b):
            return held[a][p][b] if a in held else held[b][p][a] if b in held else diagonal[p][a]
        return np.array([[entry(a, b) for b in at] for a in at])

    def score(idx):
        at = [0, *(j + 1 for j in idx), last]
        gs = {p: small(p, at) for p in products.parts}
        whole = sum(gs.values())
        return float(np.mean([_r2(whole - g, g) for g in gs.values()]))
    chosen: list[int] = []
    best: dict[int, float] = {}
    while len(chosen) < min(k, len(features)):
        gains = [(score([*chosen, j]), -j) for j in range(len(features)) if j not in chosen]
        top, at = max(gains)
        chosen.append(-at)
        if 1 - at not in held:
            held[1 - at] = {p: line[0] for p, (line, _) in products.lines((1 - at,)).items()}
        best[len(chosen)] = max(top, best.get(len(chosen), float("-inf")))
        while len(chosen) > 2:   # step back while a smaller set beats the best of its size
            backs = [(score([c for c in chosen if c != j]), -j) for j in chosen[:-1]]
            back, at = max(backs)
            if back <= best.get(len(chosen) - 1, float("-inf")):
                break
            chosen.remove(-at)
            best[len(chosen)] = back
    return [features[j] for j in chosen]


def _r2(train: np.ndarray, test: np.ndarray) -> float:
    """R2 on ``test`` of the model fitted on ``train``; both are small product matrices."""
    w = np.concatenate([solve(train), [-1.0]])
    total = test[-1, -1] - test[0, -1] ** 2 / test[0, 0]
    return float(1.0 - w @ test @ w / total) if total > 0 else float("-inf")


def score_columns(table: DataFrame, key: str, target: str, features: Sequence[str]) -> float:
    """Hold-out R2 of the linear user model on the listed columns."""
    split = hold_out(table, key).withColumn("is_train", F.col("is_train").cast("int"))
    return _products(split, target, features, "is_train").r2([1], [0])


def selection_overlap(selected: Sequence[str], useful: Sequence[str]) -> float:
    """Share of the individually useful features among the selected ones."""
    return len(set(selected) & set(useful)) / len(set(selected)) if selected else 0.0


# ---- random injection ------------------------------------------------------------------------

def mixing_weights(p: int, share: float = ETA, seed: int = 42) -> np.ndarray:
    """Standard normal weights: a row per random column, a column per original feature."""
    return np.random.default_rng(seed).standard_normal((math.ceil(share * p), p))


def add_random_features(table: DataFrame, features: Sequence[str], share: float = ETA,
                        seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Add ceil(share * p) random columns with each row's own mean and the rows' own covariance.

    A draw from that distribution over all rows is ``mean + sum_j z_j (x_j - mean) / sqrt(p - 1)`` with
    one standard normal z per original column, so no row-by-row covariance is ever formed.
    """
    p = len(features)
    if p < 2:
        raise ValueError("random features need at least two original ones")
    z = mixing_weights(p, share, seed)
    xs = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features]
    out = table.withColumn("__xs", F.array(*xs)).withColumn(
        "__m", F.aggregate("__xs", F.lit(0.0), lambda a, x: a + x) / p)
    names = [f"{RANDOM_PREFIX}{i}" for i in range(len(z))]

    def mixed(row):
        weights = F.array(*[F.lit(float(w)) for w in row])
        return F.aggregate(F.zip_with("__xs", weights, lambda x, w: (x - F.col("__m")) * w),
                           F.lit(0.0), lambda a, v: a + v)
    out = out.withColumns({name: F.col("__m") + mixed(row) / math.sqrt(p - 1)
                           for name, row in zip(names, z)})
    return out.drop("__xs", "__m"), names


def combined_ranking(coefs: DataFrame, group: Sequence[str] = ("ranking",),
                     mix: float = 0.5) -> DataFrame:
    """Rank ``(ranking, col, rf, lasso)`` by a blend of forest importance and shifted lasso weight."""
    w = Window.partitionBy(*group)   # one row per feature
    shifted = coefs.withColumn("__s", F.col("lasso") - F.min("lasso").over(w))
    total = F.nullif(F.sum("__s").over(w), F.lit(0.0))
    blend = mix * F.col("rf") + (1 - mix) * F.coalesce(F.col("__s") / total, F.lit(0.0))
    return shifted.withColumn("score", blend).withColumn(
        "rank", F.row_number().over(w.orderBy(F.desc("score"), "col"))).drop("__s")


def injection_quality(rankings: DataFrame, prefix: str = RANDOM_PREFIX) -> DataFrame:
    """Share of rankings in which a feature stands before every random one."""
    is_random = F.col("col").startswith(prefix)
    firsts = rankings.groupBy("ranking").agg(
        F.min(F.when(is_random, F.col("rank"))).alias("first_random"))
    return rankings.where(~is_random).join(firsts, "ranking").groupBy("col").agg(
        F.avg((F.col("rank") < F.coalesce("first_random", F.lit(2 ** 31))).cast("double"))
        .alias("quality"))


def forest_weights(rows: DataFrame, key: str, n_features: int, seeds: Sequence[int], trees: int, depth: int) -> dict[int, list[float]]:
    """Importances of the features in a forest per seed, all of which are grown together; ``rows``: (key, xs, y)."""
    forests = fit_forests(rows.select(F.lit(0).alias("part"), key, "xs", "y"), ["part"], [key], trees=trees, depth=depth, seeds=seeds)
    weights = {seed: [0.0] * n_features for seed in seeds}
    for r in forest_importances(forests, ["part"]).collect():            # one row per seed and feature
        weights[r["seed"]][r["feature"]] = r["importance"]
    return weights


def injection_rankings(table: DataFrame, key: str, target: str, features: Sequence[str],
                       seeds: Sequence[int] = SEEDS, trees: int = 100, depth: int = DEPTH) -> DataFrame:
    """One ranking per seed from a forest and a lasso on the table with random columns."""
    wide, randoms = add_random_features(table.na.drop(), features)
    names = [*features, *randoms]
    stored = materialise(wide.select(key, F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("xs"), F.col(target).cast("double").alias("y")))
    # without randomness in the solver one lasso serves all seeds
    rows = stored.select(key, array_to_vector("xs").alias("features"), F.col("y").alias("label"))
    lasso = LinearRegression(elasticNetParam=1.0, regParam=1.0, standardization=False).fit(in_fixed_order(rows, [key]))
    weights = forest_weights(stored, key, len(names), seeds, trees, depth)
    found = [(seed, n, r, float(c)) for seed in seeds for n, r, c in zip(names, weights[seed], lasso.coefficients.toArray())]
    coefs = table.sparkSession.createDataFrame(found, "ranking int, col string, rf double, lasso double")
    return combined_ranking(coefs)


def random_injection(table: DataFrame, key: str, target: str, features: Sequence[str],
                     taus: Sequence[float] = TAUS, keep: str = "last", **kw) -> list[str]:
    """Raise the quality threshold until the hold-out R2 of a linear model stops rising.

    ``keep='last'`` returns the set that ended the search, ``'best'`` the one before it.
    """
    quality = {r["col"]: r["quality"] for r in injection_quality(
        injection_rankings(table, key, target, features, **kw)).collect()}
    products = _products(hold_out(table, key).withColumn("is_train", F.col("is_train").cast("int")), target, features, "is_train")
    best_r2, best, last = float("-inf"), [], []
    for tau in taus:
        last = [f for f in features if quality.get(f, 0.0) >= tau]
        if not last:
            break
        r2 = products.r2([1], [0], [features.index(f) for f in last])
        if r2 <= best_r2:
            break
        best_r2, best = r2, last
    return last if keep == "last" else best


# ---- shadow features -------------------------------------------------------------------------

def shadow_table(table: DataFrame, key: str, features: Sequence[str], seed: str) -> DataFrame:
    """Add ``<feature>_shadow``: each feature shuffled over the rows, each by another shift."""
    placed = materialise(hash_order(table, [], [key], seed=seed))
    n = F.col("pos_total")
    # every value travels once to its new position, where a row's shadows meet: one join for all features
    moves = F.array(*[F.struct(F.pmod(F.col("pos") + hash32(F.lit(f), seed=seed) % n, n).alias("to"), F.lit(i).alias("i"),
                               F.col(f"`{f}`").cast("double").alias("v")) for i, f in enumerate(features)])
    shadows = placed.select(F.explode(moves).alias("m")).groupBy(F.col("m.to").alias("pos")).agg(*[
        F.max(F.when(F.col("m.i") == i, F.col("m.v"))).alias(f"{f}_shadow") for i, f in enumerate(features)])
    return placed.join(shadows, "pos").drop("pos", "pos_total")


def _at_least(hits: int, trials: int) -> float:
    """Chance of that many or more hits in fair coin tosses."""
    return sum(math.comb(trials, i) for i in range(hits, trials + 1)) / 2.0 ** trials


def _sure_rounds(done: int, rounds: int, hits: dict[str, int], undecided: Sequence[str], limit: float) -> int:
    """How many rounds are sure to follow with the same features: up to the first that could reject one, or decide the last."""
    def first(f, hit):
        return next((t for t in range(done + 1, rounds) if _at_least(hits[f] + t - done if hit else t - hits[f], t) < limit), rounds)
    rejected = {f: first(f, False) for f in undecided}
    return min(*rejected.values(), max(min(rejected[f], first(f, True)) for f in undecided)) - done


def _shadow_weights(table: DataFrame, key: str, target: str, active: Sequence[str], turns: Sequence[int], trees: int, depth: int) -> dict[int, list[float]]:
    """Importances of the features, then of their shadows, per round; the forests of all these rounds are grown together."""
    names = [*active, *[f"{f}_shadow" for f in active]]
    rows = None
    for r in turns:
        wide = shadow_table(table.select(key, target, *active), key, active, f"shadow{r}")
        own = wide.select(F.lit(r).alias("round"), key, F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("xs"),
                          F.col(target).cast("double").alias("y"))
        rows = own if rows is None else rows.unionByName(own)
    forests = fit_forests(rows, ["round"], [key], trees=trees, depth=depth, seeds=None)
    weights = {r: [0.0] * len(names) for r in turns}
    for w in forest_importances(forests, ["round"]).collect():           # one row per round and feature
        weights[w["round"]][w["feature"]] = w["importance"]
    return weights


def shadow_selection(table: DataFrame, key: str, target: str, features: Sequence[str],
                     rounds: int = 20, level: float = 0.05, trees: int = 100,
                     depth: int = DEPTH, confirmed_only: bool = False) -> dict[str, str]:
    """Which features beat the best shadow: ``confirmed``, ``tentative`` or ``rejected``.

    Rounds that are sure to follow whatever the last ones say share their jobs, as far as their rows are few.
    """
    hits = {f: 0 for f in features}
    undecided = list(features)
    verdict: dict[str, str] = {}
    limit = level / max(1, len(features))
    table = materialise(table.select(key, target, *features))
    at_once = max(1, ROUND_ROWS // max(1, table.count()))
    weights: dict[int, list[float]] = {}
    for r in range(1, rounds + 1):
        active = [f for f in features if verdict.get(f) != "rejected"]
        if not undecided or not active:
            break
        if r not in weights:
            n = min(at_once, _sure_rounds(r - 1, rounds, hits, undecided, limit))
            weights = _shadow_weights(table, key, target, active, range(r, r + n), trees, depth)
        weight = weights[r]
        bar = max(weight[len(active):])
        for f, w in zip(active, weight):
            hits[f] += w > bar
        for f in list(undecided):
            if _at_least(hits[f], r) < limit:
                verdict[f] = "confirmed"
            elif _at_least(r - hits[f], r) < limit:
                verdict[f] = "rejected"
            else:
                continue
            undecided.remove(f)
    out = {f: verdict.get(f, "tentative") for f in features}
    return {f: v for f, v in out.items() if v == "confirmed"} if confirmed_only else out
