"""Histogram forests: splits by brute force, both ways of growing, predictions and importances."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from joinlift.operators import forests
from joinlift.operators.forests import BINS, best_splits, chosen, draws, fit_forests, forest_importances, grow, predict_forests, sums_by_bin


def data(n, p, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)).round(2)
    return x, 3 * (x[:, 0] > 0.2) + x[:, 1] ** 2 + 0.1 * rng.normal(size=n)


def frame(spark, parts):
    rows = [(g, f"{g}-{i}", r.tolist(), float(v)) for g, x, y in parts for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["g", "id", "xs", "y"]), "g string, id string, xs array<double>, y double").repartition(5)


def test_splits_are_the_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, p, m = 60, 4, 3
        bins, at = rng.integers(0, BINS, (n, p)).astype(np.uint8), rng.integers(0, m, n)
        y, w = rng.normal(size=n).round(1), rng.integers(0, 3, n).astype(float)
        features = chosen(5, 6, np.arange(m), p, 2)
        feature, last, gain, weight, total = best_splits(sums_by_bin(bins, w, w * y, at, features), features)
        for node in range(m):
            here = (at == node) & (w > 0)
            def loss(mask):
                return ((y[mask] - np.average(y[mask], weights=w[mask])) ** 2 * w[mask]).sum() if mask.any() else 0.0
            best = {}
            for f in features[node]:
                for b in range(BINS - 1):
                    left, right = here & (bins[:, f] <= b), here & (bins[:, f] > b)
                    if left.any() and right.any():
                        best[f, b] = loss(here) - loss(left) - loss(right)
            assert gain[node] == pytest.approx(max(best.values()), abs=1e-9)
            assert best[feature[node], last[node]] == pytest.approx(gain[node], abs=1e-9)
            assert weight[node] == w[here].sum() and total[node] == pytest.approx((w * y)[here].sum())


def test_samples_and_choices_are_random_and_repeat():
    h = np.arange(100_000, dtype=np.uint64)
    w = draws(h, 42, 7)
    assert (w == draws(h, 42, 7)).all() and (w != draws(h, 42, 8)).any()
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    picked = chosen(1, 2, np.arange(3000), 9, 3)
    assert picked.shape == (3000, 3) and (np.diff(picked, axis=1) > 0).all()
    assert abs(np.bincount(picked.ravel(), minlength=9) / 3000 - 1 / 3).max() < 0.05


def test_levels_as_jobs_grow_the_same_trees(spark):
    parts = [("a", *data(700, 6, 2)), ("b", *data(300, 3, 3)), ("c", np.zeros((40, 2)), np.arange(40.0)), ("d", np.ones((1, 2)), np.array([5.0]))]
    rows = frame(spark, parts)
    settings = dict(trees=4, depth=4, seeds=(1, 9))
    one, two = (sorted(fit_forests(rows, ["g"], ["id"], local_numbers=most, **settings).collect(), key=lambda r: (r["g"], r["seed"], r["tree"]))
                for most in (10 ** 9, 0))
    assert len(one) == len(two) == 4 * 8
    for a, b in zip(one, two):
        assert (a["g"], a["seed"], a["tree"], a["node"], a["feature"], a["cut"], a["weight"]) == \
               (b["g"], b["seed"], b["tree"], b["node"], b["feature"], b["cut"], b["weight"])
        assert np.allclose(a["value"], b["value"]) and np.allclose(a["gain"], b["gain"])
        if a["g"] in "cd":
            assert a["feature"] == [-1]


def test_trees_are_those_of_one_plain_run(spark):
    x, y = data(500, 4, 4)
    rows = frame(spark, [("a", x, y)])
    groups, blocks = forests.blocks_of(rows, ["g"], ["id"])
    of = groups.first()
    bins, centred, hashes = forests._unpacked(blocks.collect(), 4)
    tree = grow(bins, centred, hashes, 3, 0, 5, 1.0).row(of["cuts"], of["mean"])
    got = fit_forests(rows, ["g"], ["id"], trees=1, depth=5, seeds=(3,), share=1.0).first()
    assert got["node"] == tree[2] and got["cut"] == tree[4]
    assert all(len(c) <= BINS - 1 and list(c) == sorted(set(c)) for c in of["cuts"])


def test_predictions_and_importances(spark):
    train, test = data(4000, 6, 5), data(1000, 6, 6)
    rows = frame(spark, [("a", *train), ("b", train[0][:, :1], train[0][:, 0] * 2)])
    grown = fit_forests(rows, ["g"], ["id"], trees=30, depth=7)
    out = predict_forests(frame(spark, [("a", *test), ("b", test[0][:, :1], test[0][:, 0] * 2), ("none", *data(3, 2, 7))]), grown, ["g"], ["id"], slice_rows=150).toPandas()
    assert set(out.g) == {"a", "b"} and len(out) == 2000
    for _, p in out.groupby("g"):
        assert 1 - ((p.y - p.yhat) ** 2).mean() / p.y.var() > 0.85
    weights = forest_importances(grown, ["g"]).toPandas()
    for _, p in weights.groupby("g"):
        assert p.importance.sum() == pytest.approx(1)
    a = weights[weights.g == "a"].set_index("feature").importance
    assert {0, 1} == set(a.nlargest(2).index) and a[0] + a[1] > 0.8


def test_empty_and_missing(spark):
    rows = spark.createDataFrame([("a", "1", [None, 1.0], 2.0), ("a", "2", [float("nan"), 3.0], 4.0), ("a", "3", [0.0, 0.0], None), ("b", "4", [], 1.0)],
                                 "g string, id string, xs array<double>, y double")
    grown = fit_forests(rows, ["g"], ["id"], trees=2, depth=3)
    out = {r["id"]: r["yhat"] for r in predict_forests(rows, grown, ["g"], ["id"]).collect()}
    assert set(out) == {"1", "2", "3", "4"} and out["4"] == 1.0 and 2.0 <= out["1"] <= 4.0
    assert fit_forests(rows.limit(0), ["g"], ["id"], trees=2).count() == 0


def test_blocks_are_summed_in_slices(monkeypatch):
    rng = np.random.default_rng(8)
    bins, h = rng.integers(0, BINS, (700, 5)).astype(np.uint8), rng.integers(0, 2 ** 63, 700).astype(np.uint64)
    y = np.where(bins[:, 0] > 9, 4.0, 1.0) + bins[:, 1]
    whole = grow(bins, y, h, 3, 1, 6, 0.5).row([list(range(BINS))] * 5, 0.0)
    monkeypatch.setattr(forests, "SLICE_ROWS", 64)
    parts = forests.grow_from([(bins[i:j], y[i:j], h[i:j]) for i, j in ((0, 300), (300, 301), (301, 700))], 3, 1, 6, 0.5).row([list(range(BINS))] * 5, 0.0)
    assert whole == parts
    w = np.bincount(np.searchsorted(forests.POISSON, (forests._mix(h ^ forests._of(3, 1)) >> np.uint64(11)).astype(float) / 2.0 ** 53, "right"))
    assert (np.bincount(draws(h, 3, 1).astype(int)) == w).all()


@pytest.mark.parametrize("most", [10 ** 9, 0])
def test_each_group_may_have_its_own_seed(spark, most):
    x, y = data(300, 4, 9)
    rows = spark.createDataFrame(pd.DataFrame([(s, f"{i}", r.tolist(), float(v)) for s in (5, 8) for i, (r, v) in enumerate(zip(x, y))],
                                              columns=["round", "id", "xs", "y"]), "round int, id string, xs array<double>, y double")
    got = {(r["seed"], r["tree"]): r for r in fit_forests(rows, ["round"], ["id"], trees=2, depth=3, seeds=None, local_numbers=most).collect()}
    assert set(got) == {(s, t) for s in (5, 8) for t in range(2)} and all(r["round"] == s for (s, _), r in got.items())
    alone = fit_forests(rows.where("round = 8"), ["round"], ["id"], trees=2, depth=3, seeds=(8,)).collect()
    assert all(got[8, r["tree"]]["cut"] == r["cut"] for r in alone)


def test_shares_of_few_groups_have_a_task_each(spark):
    groups = spark.createDataFrame([("a", 1), (None, 1), ("b", None)], "g string, h int")
    turns = forests._turns(groups, ["g", "h"], 6, 40)
    found = turns.select("g", "h", "__share", "__turn", F.pmod(F.hash("g", "h", "__turn"), F.lit(40)).alias("task")).toPandas()
    assert len(found) == 18 and found.task.nunique() == 18 and set(found["__share"]) == set(range(6))
    dealt = turns.repartition(40, "g", "h", "__turn").select(F.spark_partition_id().alias("at"), "__turn").toPandas()
    assert dealt["at"].nunique() == 18                                                   # where Spark's own shuffle sends them
    many = forests._turns(groups, ["g", "h"], 6, 17).toPandas()
    assert len(many) == 18 and (many["__share"] == many["__turn"]).all()


def test_rows_on_their_way_are_found_again(spark):
    x, y = data(900, 4, 11)
    rows = frame(spark, [("a", x, y)])
    made = {}
    for most in (10 ** 9, 0):
        made[most] = sorted((r["tree"], tuple(r["node"]), tuple(r["cut"]), tuple(r["weight"])) for r in
                            fit_forests(rows, ["g"], ["id"], trees=13, depth=6, local_numbers=most).collect())
    assert made[0] == made[10 ** 9] and [t[0] for t in made[0]] == list(range(13))
    h = np.random.default_rng(1).integers(0, 2 ** 63, 5000).astype(np.uint64)
    kept = h.copy()
    u = forests._mix(h ^ forests._of(7, 3))
    assert (draws(h, 7, 3) == np.searchsorted(forests.POISSON, (u >> np.uint64(11)).astype(float) / 2.0 ** 53, "right")).all() and (h == kept).all()
