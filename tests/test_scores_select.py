"""The bulk linear model, selectors and metamodel on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from joinlift.operators import metamodel, prune, scores, select
from joinlift.plans import runs

CELL = "dataset_id string, row_key string, col string, v double"
PAIR = "query_id string, target string, candidate_id string"


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(size=(n, 5))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.1 * rng.normal(size=n)
    out = pd.DataFrame(x, columns=[f"f{i}" for i in range(5)])
    out.insert(0, "k", [f"r{i}" for i in range(n)])
    out["y"] = y
    return out


def test_before_and_after_equals_least_squares(spark, wide):
    rows = [("q", k, c, float(v)) for c in ("y", "f0") for k, v in zip(wide.k, wide[c])]
    rows += [("c", k, "f1", float(v)) for k, v in zip(wide.k[:400], wide.f1)]
    cells = spark.createDataFrame(rows, CELL)
    pairs = spark.createDataFrame([("q", "y", "c")], PAIR)
    got = scores.before_and_after(pairs, cells).first()
    from joinlift.operators.splits import hold_out
    side = hold_out(spark.createDataFrame(wide[["k"]]), "k").toPandas().set_index("k").is_train
    tr = wide.k.map(side).to_numpy(dtype=bool)
    f1 = wide.f1.where(wide.index < 400, wide.f1[:400].mean())
    for stage, cols in (("before", [wide.f0]), ("after", [wide.f0, f1])):
        z = np.column_stack([np.ones(len(wide)), *cols])
        b = np.linalg.lstsq(z[tr], wide.y[tr], rcond=None)[0]
        e = (wide.y - z @ b)[~tr]
        assert got[f"mae_{stage}"] == pytest.approx(np.abs(e).mean())
        assert got[f"mse_{stage}"] == pytest.approx((e ** 2).mean())
        assert got[f"medae_{stage}"] == pytest.approx(np.median(np.abs(e)))
        assert got[f"r2_{stage}"] == pytest.approx(1 - (e ** 2).sum() / ((wide.y[~tr] - wide.y[~tr].mean()) ** 2).sum())
    flags = scores.improvement_flags(scores.before_and_after(pairs, cells)).first()
    assert flags["r2_improved"] and flags["mae_improved"]


@pytest.fixture(scope="module")
def joined_cells(spark, wide):
    rows = [("q", k, c, float(v)) for c in ("y", "f0") for k, v in zip(wide.k, wide[c])]
    rows += [("c", k, "f1", float(v)) for k, v in zip(wide.k[:400], wide.f1)]
    return spark.createDataFrame([*rows, *[("lone", k, "y", float(v)) for k, v in zip(wide.k, wide.y)]], CELL)


def test_other_user_models(spark, joined_cells):
    pairs = spark.createDataFrame([("q", "y", "c"), ("lone", "y", "c")], PAIR)
    plain = {r["query_id"]: r for r in scores.before_and_after(pairs, joined_cells).collect()}
    same = {r["query_id"]: r for r in scores.before_and_after_with("linear", pairs, joined_cells).collect()}
    for q in ("q", "lone"):
        for m in scores.ERRORS:
            for s in ("before", "after"):
                assert same[q][f"{m}_{s}"] == pytest.approx(plain[q][f"{m}_{s}"], rel=1e-6, abs=1e-9)
    forest = scores.before_and_after_with("random forest", pairs.where("query_id = 'q'"), joined_cells, trees=20).first()
    assert forest["r2_after"] > forest["r2_before"] > 0.5
    record = scores.training_records(scores.before_and_after(pairs, joined_cells), algorithm="linear").first()
    assert record["algorithm"] == "linear"
    assert scores.before_and_after_with("linear", pairs.where("false"), joined_cells).count() == 0


def test_best_imputation_has_the_lowest_error(spark, joined_cells):
    pairs = spark.createDataFrame([("q", "y", "c")], PAIR)
    each = {s: scores.before_and_after(pairs, joined_cells, strategy=s).first()["mae_after"] for s in ("mean", "median", "most_frequent")}
    best = scores.with_best_imputation(pairs, joined_cells).first()
    assert best["mae_after"] == pytest.approx(min(each.values())) and each[best["strategy"]] == pytest.approx(min(each.values()))


def test_recorded_relative_scores(spark):
    df = spark.createDataFrame([(0.0562187572, 0.2827487144, 0.6700611970, 0.5472515171)], "r0 double, r1 double, e0 double, e1 double")
    got = df.select(scores.relative_gain("r0", "r1"), scores.relative_change("e0", "e1")).first()
    assert got[0] == pytest.approx(4.0294373004, rel=1e-7) and got[1] == pytest.approx(-0.1832812890, rel=1e-7)


def test_best_step_takes_the_smaller_of_equal_ones(spark):
    grid = spark.createDataFrame([(0.2, "gain", 0.5), (0.1, "gain", 0.5), (0.0, "gain", 0.4), (0.3, "loss", 0.9)], "alpha double, class string, f1 double")
    assert metamodel.best_step(grid, "alpha").first().asDict() == {"alpha": 0.1, "f1": 0.5}


def test_a_constant_feature_has_no_weight(spark):
    t = pd.DataFrame({"g": ["a"] * 20, "xs": [[1.0 * i, 7.0] for i in range(20)], "y": [2.0 * i + 1 for i in range(20)]})
    coef = scores.fit_linear(spark.createDataFrame(t), ["g"]).first()["coef"]
    assert coef == pytest.approx([1.0, 2.0, 0.0])


def test_relative_scores_handle_zero_and_null(spark):
    df = spark.createDataFrame([(2.0, 3.0), (-2.0, 3.0), (0.0, 1.0), (None, 1.0), (2.0, 0.0)], "b double, a double")
    got = [r[0] for r in df.select(scores.relative_gain("b", "a")).collect()]
    assert got == [0.5, 2.5, None, None, -1.0]


FEATURES = [f"f{i}" for i in range(5)]


def test_selectors_find_the_two_that_matter(spark, wide):
    t = spark.createDataFrame(wide)
    assert set(select.recursive_elimination(t, "y", FEATURES)) == {"f0", "f1"}
    assert set(select.forward_stepwise(t, "k", "y", FEATURES, k=2)) == {"f0", "f1"}
    for name in ("f_test", "correlation", "mutual_information"):
        assert set(runs.select_features(t, "k", "y", FEATURES, name)) == {"f0", "f1"}
    assert select.score_columns(t, "k", "y", ["f0", "f1"]) > 0.99


def test_correlated_and_constant_features(spark, wide):
    t = spark.createDataFrame(wide.assign(copy=wide.f0 * 2 + 1, flat=1.0))
    assert select.correlated(t, [*FEATURES, "copy", "flat"]) == ["copy"]
    cells = select.unpivot(t, "k", "y", [*FEATURES, "flat"])
    assert [r["col"] for r in select.low_variance(cells).collect()] == ["flat"]


def test_random_features_have_the_rows_moments(spark):
    rows = pd.DataFrame({"k": ["a", "b"], "u": [1.0, 10.0], "v": [3.0, 10.0], "w": [8.0, 16.0]})
    wide, names = select.add_random_features(spark.createDataFrame(rows), ["u", "v", "w"], share=1.0, seed=3)
    got = wide.orderBy("k").select(*names).toPandas().to_numpy()
    x = rows[["u", "v", "w"]].to_numpy()
    m = x.mean(axis=1, keepdims=True)
    root = (x - m) / np.sqrt(2)
    z = np.random.default_rng(3).standard_normal((3, 3))
    assert got == pytest.approx(m + root @ z.T)          # z is standard normal, so
    assert root @ root.T == pytest.approx(np.cov(x))     # the draws have the rows' own covariance


def test_injection_and_shadows(spark, wide):
    t = spark.createDataFrame(wide)
    kw = dict(trees=10, depth=5)
    kept = select.random_injection(t, "k", "y", FEATURES, seeds=(42, 17), keep="best", **kw)
    assert {"f0"} <= set(kept)
    verdict = select.shadow_selection(t, "k", "y", FEATURES, rounds=8, level=0.2, **kw)
    assert verdict["f0"] == "confirmed" and verdict["f1"] == "confirmed"
    assert select.selection_overlap(["f0", "f1", "f2", "f3"], ["f0", "f1"]) == 0.5


def test_shadows_are_permutations(spark, wide):
    out = select.shadow_table(spark.createDataFrame(wide), "k", ["f0", "f1"], "s").toPandas()
    assert len(out) == len(wide)
    assert sorted(out.f0_shadow) == sorted(wide.f0) and (out.f0_shadow != out.f0).mean() > 0.9


@pytest.fixture(scope="module")
def instances():
    rng = np.random.default_rng(4)
    n = 400
    a, b = rng.random(n), rng.random(n)
    gain = a - 0.5 + 0.1 * rng.normal(size=n)
    return pd.DataFrame({"query_id": [f"q{i % 10}" for i in range(n)], "target": "t",
                         "candidate_id": [f"c{i}" for i in range(n)], "a": a, "b": b, "gain": gain,
                         "class": np.where(gain > 0, "gain", "loss"), "containment": a})


def test_metamodel_prunes_and_survives_saving(spark, instances, tmp_path):
    df = spark.createDataFrame(instances)
    model = metamodel.train_classifier(df, ["a", "b"], trees=10, depth=4)
    metamodel.save(model, str(tmp_path / "m"))
    again = metamodel.load(str(tmp_path / "m"))
    one = metamodel.apply_classifier(model, df, ["a", "b"]).toPandas()
    two = metamodel.apply_classifier(again, df, ["a", "b"]).toPandas()
    assert (one["pred_class"] == one["class"]).mean() > 0.85
    assert one.sort_values("candidate_id").score.tolist() == two.sort_values("candidate_id").score.tolist()
    kept = prune.by_model(df, metamodel.scorer(model, ["a", "b"]), n=5).toPandas()
    assert (kept.groupby("query_id").size() <= 5).all() and (kept.score > 0.5).all()
    batch = metamodel.apply_classifier(model, df, ["a", "b"], rescale="batch")
    assert batch.count() == len(instances)


def test_two_step_survivors_pass_the_first_model(spark, instances):
    df = spark.createDataFrame(instances)
    step = lambda rows: rows.withColumn("score", F.col("a"))
    ids = df.select("query_id", "target", "candidate_id")
    look = lambda p: df.join(p, p.columns, "left_semi")
    kept = prune.in_two_steps(ids, look, look, step, lambda r: r.withColumn("score", F.col("b")), n=3).toPandas()
    assert (kept.a > 0.5).all() and (kept.b > 0.5).all()
    early = prune.in_two_steps(ids, look, look, step, step, pruned_share=0.01, early_exit=True)
    assert early.count() == (instances.a > 0.5).sum()


def test_seeds_folds_and_grids(spark, instances):
    df = spark.createDataFrame(instances)
    flips = metamodel.seed_flips(df, df, ["a", "b"], trees=5, depth=3).toPandas()
    assert (flips.flips == (flips.pred_0 != flips.pred_1)).all()
    report, models = metamodel.cross_validate(df, 2, ["a", "b"], trees=5, depth=3)
    assert report.count() == 2 and len(models) == 2
    grid = metamodel.threshold_grid(df, df, ["a", "b"], [0.0, 0.3], trees=5, depth=3).toPandas()
    assert list(grid.sort_values("alpha").alpha) == [0.0, 0.3] and grid.f1.between(0, 1).all()


def test_prune_and_select_run(spark, wide):
    rows = [("base", k, c, float(v)) for c in ("y", "f2") for k, v in zip(wide.k, wide[c])]
    rows += [(f"cand{i}", k, "x", float(v)) for i in (0, 1, 3) for k, v in zip(wide.k, wide[f"f{i}"])]
    cells = spark.createDataFrame(rows, CELL)
    pairs = spark.createDataFrame([("base", "y", f"cand{i}") for i in (0, 1, 3)], PAIR)
    row = runs.prune_and_select("base", "y", pairs, cells, selector="elimination").first()
    assert row["r2_before"] < 0.2 and row["r2_after"] > 0.99
    assert set(row["selected"].split(",")) == {"cand0__x", "cand1__x"}


def test_partitions_of_training_rows_stay_few(spark):
    def parts(n):
        return metamodel.in_fixed_order(spark.range(n), ["id"]).rdd.getNumPartitions()
    assert (parts(0), parts(10_000), parts(45_000)) == (1, 1, 5)
    assert parts(2_000_000) == metamodel.FEW_PARTITIONS
    assert metamodel.partitions_of(144_000_000) == 144


def test_rounds_of_shadows_share_jobs_only_where_they_are_sure(spark, monkeypatch):
    assert select._sure_rounds(0, 20, {"a": 0, "b": 0}, ["a", "b"], 0.05 / 7) == 8       # 0.5^8 < 0.05/7
    assert select._sure_rounds(8, 20, {"a": 4}, ["a"], 0.05 / 7) == next(
        t for t in range(9, 21) if t == 20 or select._at_least(t - 4, t) < 0.05 / 7) - 8
    rng = np.random.default_rng(3)
    rows = [(str(i), float(a), float(b), float(3.0 * a + 0.01 * n)) for i, (a, b, n) in enumerate(rng.normal(size=(200, 3)))]
    t = spark.createDataFrame(rows, "k string, a double, b double, y double")
    turns = []
    made = select._shadow_weights
    monkeypatch.setattr(select, "_shadow_weights", lambda *a: turns.append(len(a[4])) or made(*a))
    one = select.shadow_selection(t, "k", "y", ["a", "b"], rounds=7, trees=3, depth=3)
    assert turns[0] == 6 and one["a"] == "confirmed"
    monkeypatch.setattr(select, "ROUND_ROWS", 1)
    assert select.shadow_selection(t, "k", "y", ["a", "b"], rounds=7, trees=3, depth=3) == one and set(turns[-7:]) >= {1}
