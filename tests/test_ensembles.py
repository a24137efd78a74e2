"""Forests of large tables: grown by ``forests``, handed over as models of Spark ML."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from joinlift.operators import ensembles, metamodel

KEY = ["query_id", "target", "candidate_id"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.random((3000, 5)).round(3)
    gain = 2.0 * (x[:, 0] > 0.4) + x[:, 1] ** 2 - 1 + 0.2 * rng.normal(size=3000)
    table = pd.DataFrame(x, columns=list("abcde")).assign(
        query_id="q", target="t", candidate_id=[f"c{i}" for i in range(3000)], gain=gain, **{"class": np.where(gain > 0.3, "gain", "loss")})
    return spark.createDataFrame(table).repartition(4)


@pytest.fixture
def large(monkeypatch):
    monkeypatch.setattr(metamodel, "FOREST_ROWS", 100)
    monkeypatch.setattr(metamodel, "in_fixed_order", lambda *a, **k: pytest.fail("left to Spark ML"))


def both(monkeypatch, train):
    monkeypatch.setattr(metamodel, "FOREST_ROWS", 10 ** 9)
    plain = train()
    monkeypatch.setattr(metamodel, "FOREST_ROWS", 100)
    return plain, train()


def test_classifier_is_as_good_as_spark_mls(rows, monkeypatch, tmp_path):
    train, test = rows.where(F.xxhash64("candidate_id") % 3 != 0), rows.where(F.xxhash64("candidate_id") % 3 == 0)
    features = list("abcde")
    models = both(monkeypatch, lambda: metamodel.train_classifier(train, features, trees=30, depth=6))
    a, b = (metamodel.apply_classifier(m, test, features).toPandas().set_index("candidate_id").sort_index() for m in models)
    right = [(p["class"] == p.pred_class).mean() for p in (a, b)]
    assert abs(right[0] - right[1]) < 0.02 and right[1] > 0.85 and np.corrcoef(a.score, b.score)[0, 1] > 0.97
    assert list(a.columns) == list(b.columns)
    kinds = [type(m.stages[-1]) for m in models]
    assert kinds[0] is kinds[1] and models[1].stages[-1].getNumTrees == 30 and models[1].stages[-1].numClasses == 2
    w = [m.stages[-1].featureImportances.toArray() for m in models]
    assert w[1].sum() == pytest.approx(1) and np.abs(w[0] - w[1]).max() < 0.06
    metamodel.save(models[1], str(tmp_path / "m"))
    again = metamodel.apply_classifier(metamodel.load(str(tmp_path / "m")), test, features).toPandas().set_index("candidate_id").sort_index()
    assert (again.score == b.score).all()


def test_regressor_is_as_good_as_spark_mls(rows, monkeypatch):
    train, test = rows.where(F.xxhash64("candidate_id") % 3 != 0), rows.where(F.xxhash64("candidate_id") % 3 == 0)
    features = list("abcde")
    models = both(monkeypatch, lambda: metamodel.train_regressor(train, features, trees=30, depth=7))
    p = [metamodel.apply_regressor(m, test, features).toPandas() for m in models]
    r2 = [1 - ((q.gain - q.score) ** 2).mean() / q.gain.var() for q in p]
    assert abs(r2[0] - r2[1]) < 0.03 and r2[1] > 0.8
    trees = [m.stages[-1].totalNumNodes for m in models]
    assert 0.7 < trees[1] / trees[0] < 1.4


def test_a_large_forest_is_not_left_to_spark_ml(rows, large):
    features = list("abcde")
    metamodel.train_regressor(rows, features, trees=3, depth=3)
    report, models = metamodel.cross_validate(rows, 2, features, trees=5, depth=4)
    assert len(models) == 2 and (report.toPandas().r2 > 0.3).all()
    flips = metamodel.seed_flips(rows, rows, features, trees=5, depth=3).toPandas()
    assert len(flips) == 3000 and (flips.p_0 != flips.p_1).mean() > 0.9 and flips.flips.sum() < 300


def test_every_row_goes_where_its_tree_sends_it(rows, large):
    """The model's mean over trees is that of the trees as grown; scaled features are those it was trained on."""
    features = list("abcde")
    model = metamodel.train_regressor(rows, features, trees=1, depth=3)      # a single tree sees all features
    ready = model.transform(rows).select(vector_to_array("features").alias("xs"), "gain", "prediction").toPandas()
    sums = ready.groupby("prediction").gain.agg(["mean", "size"])
    assert len(sums) == 8 and np.abs(sums.index - sums["mean"]).max() < 0.25 and sums["size"].min() > 1


def test_one_label_and_empty_features(spark, large):
    table = pd.DataFrame([("q", "t", f"c{i}", None if i % 3 else float(i), "loss", 0.5) for i in range(200)], columns=[*KEY, "a", "class", "gain"])
    df = spark.createDataFrame(table)
    model = metamodel.train_classifier(df, ["a"], trees=3, depth=3)
    assert {r["pred_class"] for r in metamodel.apply_classifier(model, df, ["a"]).collect()} == {"loss"}
    flat = metamodel.apply_regressor(metamodel.train_regressor(df, ["a"], trees=3, depth=3), df, ["a"]).toPandas()
    assert (flat.score == 0.5).all()


def test_leaves_that_say_the_same_are_merged():
    tree = {"tree": 0, "node": [0, 1, 2, 3, 4, 5, 6], "feature": [0, 1, 1, -1, -1, -1, -1], "cut": [.5, .2, .3, 0, 0, 0, 0],
            "value": [.5, .25, .75, .0, .4, .3, .9], "weight": [20., 10., 10., 4., 6., 3., 7.], "gain": [3., 1., 1., 0, 0, 0, 0]}
    nodes = ensembles.nodes_of(tree, 2)
    assert [n[0] for n in nodes] == list(range(5))                           # both children of node 1 say 0, so it is a leaf
    assert [n[6:9] for n in nodes] == [(1, 2, 0), (-1, -1, -1), (3, 4, 1), (-1, -1, -1), (-1, -1, -1)]
    assert len(ensembles.nodes_of(tree, None)) == 7
