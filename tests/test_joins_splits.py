"""Joins, discovery, negatives and splits against brute force."""

import numpy as np
import pandas as pd
import pytest

from joinlift.operators import assoc, joins, profile, scores, splits
from joinlift.plans import catalogue

CELL = "dataset_id string, row_key string, col string, v double"


@pytest.fixture(scope="module")
def lake(spark):
    rng = np.random.default_rng(7)
    rows = []
    for d in range(14):
        keys = rng.choice(40, int(rng.integers(5, 40)), replace=False)
        rows += [(f"d{d}", f"k{k}", "v", float(k)) for k in keys]
        rows += [(f"d{d}", "common", "v", 1.0)]
    return pd.DataFrame(rows, columns=["dataset_id", "row_key", "col", "v"])


@pytest.mark.parametrize("theta", [0.3, 0.5, 0.75, 1.0])
def test_discovery_finds_every_dataset_over_theta(spark, lake, theta):
    keys = lake.groupby("dataset_id").row_key.agg(set)
    queries = spark.createDataFrame([("d0",), ("d5",), ("d9",)], "query_id string")
    got = joins.discover(queries, spark.createDataFrame(lake, CELL), theta).toPandas()
    want = {(q, c) for q in ("d0", "d5", "d9") for c in keys.index
            if c != q and len(keys[q] & keys[c]) / len(keys[q]) >= theta}
    assert set(zip(got.query_id, got.candidate_id)) == want


def test_containment_bounds(spark, lake):
    pairs = spark.createDataFrame([("d0", f"d{i}") for i in range(14)], "query_id string, candidate_id string")
    got = joins.containment(pairs, spark.createDataFrame(lake, CELL)).toPandas().set_index("candidate_id")
    assert got.containment["d0"] == 1.0 and got.containment.between(0, 1).all()


def test_negatives_are_foreign_allowed_distinct_and_complete(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{rng.integers(3)}", f"q{i}", f"c{i}", int(rng.integers(1, 6)), int(rng.integers(1, 6)))
            for i in range(60)]
    t = pd.DataFrame(rows, columns=["source", "query_id", "candidate_id", "n_query_cols", "n_candidate_cols"])
    got = joins.negative_pairs(spark.createDataFrame(t), max_columns=7, per_query=9).toPandas()
    assert not got.duplicated(["query_id", "candidate_id"]).any()
    counts = got.groupby("query_id").size()
    for _, q in t.iterrows():
        allowed = set(t[(t.source != q.source) & (t.n_candidate_cols + q.n_query_cols <= 7)].candidate_id)
        mine = set(got[got.query_id == q.query_id].candidate_id)
        assert mine <= allowed and counts.get(q.query_id, 0) == min(9, len(allowed))


def test_many_candidate_join_skips_repeated_keys(spark):
    rows = [("base", "1", "t", 1.0), ("base", "2", "t", 2.0), ("ok", "1", "x", 5.0), ("ok", "9", "x", 7.0),
            ("bad", "1", "y", 1.0), ("bad", "1", "y", 2.0), ("inf", "1", "z", float("inf")), ("inf", "2", "z", 4.0)]
    cells = spark.createDataFrame(rows, CELL)
    cands = spark.createDataFrame([("ok",), ("bad",), ("inf",)], "candidate_id string")
    got = joins.many_candidate_join("base", cands, cells).toPandas()
    assert set(got.candidate_id) == {"base", "ok", "inf"}
    at = got.set_index(["candidate_id", "row_key"]).v
    assert at["ok", "2"] == 5.0 and at["inf", "1"] == 4.0
    wide = joins.to_wide(joins.many_candidate_join("base", cands, cells)).toPandas()
    assert len(wide) == 2 and {"base/t", "ok/x", "inf/z"} <= set(wide.columns)


def test_positional_rekey(spark):
    rows = [("q", f"a{i}", i, "t", float(i)) for i in range(3)] + [("c", f"b{i}", 10 - i, "x", float(i)) for i in range(5)]
    cells = spark.createDataFrame(rows, "dataset_id string, row_key string, row_ord long, col string, v double")
    pairs = spark.createDataFrame([("q", "c")], "query_id string, candidate_id string")
    got = joins.positional_rekey(pairs, cells).toPandas().set_index("row_key").v
    assert dict(got) == {"a0": 4.0, "a1": 3.0, "a2": 2.0, "x-3": 1.0, "x-4": 0.0}


def test_splits_partition_columns(spark):
    cols = [("d", f"c{i}", i == 0) for i in range(6)] + [("small", "a", True), ("small", "b", False)]
    df = spark.createDataFrame(cols, "dataset_id string, col string, is_target boolean")
    got = splits.make_splits(df, max_splits=4, max_columns=30).toPandas()
    assert set(got.dataset_id) == {"d"}
    seen = set()
    for _, s in got.groupby("split_no"):
        q, c = set(s[s.side == "query"].col), set(s[s.side == "candidate"].col)
        assert "c0" in q and not q & c and q | c == {f"c{i}" for i in range(6)} and c
        assert frozenset(q) not in seen
        seen.add(frozenset(q))
    one = splits.make_splits(df, 4, 30, single_candidate=True).toPandas()
    assert (one[one.side == "candidate"].groupby("split_no").size() == 1).all()


def test_group_split_is_exact_and_disjoint(spark):
    rows = spark.createDataFrame([(f"q{i % 20}", f"c{i}") for i in range(200)], "query_id string, candidate_id string")
    got = splits.split_by_groups(rows, ["query_id"], 0.5, 0.25).toPandas()
    parts = got.groupby("part").query_id.agg(set)
    assert len(got) == 200 and [len(parts[p]) for p in ("train", "valid", "test")] == [10, 5, 5]
    assert not parts["train"] & parts["test"]


def test_balanced_classes(spark):
    rows = spark.createDataFrame([("gain" if i % 4 else "loss", f"c{i}") for i in range(100)], "class string, id string")
    got = splits.balance_classes(rows, "class", ["id"]).toPandas()
    assert dict(got["class"].value_counts()) == {"gain": 25, "loss": 25}


def test_profile_of_awkward_columns(spark):
    rows = [("d", str(i), "flat", 3.0) for i in range(5)] + [("d", str(i), "holes", None if i else 1.0) for i in range(5)]
    rows += [("d", str(i), "x", float(v)) for i, v in enumerate([1, 2, 2, 3, 50])]
    got = profile.profile(spark.createDataFrame(rows, CELL)).toPandas().set_index("col")
    assert got["skewness"]["flat"] == 0 and got["kurtosis"]["flat"] == 0 and got.outlier_share["flat"] == 0
    assert got.missing_share["holes"] == pytest.approx(0.8) and got.outlier_share["holes"] == 0
    x = pd.Series([1, 2, 2, 3, 50.0])
    assert got["skewness"]["x"] == pytest.approx(x.skew()) and got["kurtosis"]["x"] == pytest.approx(x.kurt())
    assert got.n_distinct["x"] == 4


def test_rows_of_a_repeated_base_key_stay_apart(spark):
    cell = "dataset_id string, row_id string, row_key string, col string, v double"
    rows = [("base", f"r{i}", f"k{i % 10}", c, float(v)) for i in range(40) for c, v in (("t", i), ("a", i * i % 7))]
    rows += [("cand", f"k{k}", f"k{k}", "x", k * 3.0) for k in range(0, 10, 2)]
    cells = spark.createDataFrame(rows, cell)
    pairs = spark.createDataFrame([("base", "t", "cand")], "query_id string, target string, candidate_id string")
    base = pd.DataFrame([(f"r{i}", i % 10, float(i), float(i * i % 7)) for i in range(40)], columns=["r", "k", "t", "a"])
    base["x"] = base.k.map({k: k * 3.0 for k in range(0, 10, 2)})
    filled = base.assign(x=base.x.fillna(base.x.mean())).set_index("r")

    many = joins.many_candidate_join("base", pairs.select("candidate_id"), cells)
    wide = joins.to_wide(many).toPandas().set_index("row_id")
    assert len(wide) == 40
    for mine, theirs in (("t", "base/t"), ("a", "base/a"), ("x", "cand/x")):
        assert np.allclose(wide[theirs].reindex(filled.index), filled[mine])
    left = joins.augmentation_join(pairs, cells).where("side = 'candidate'").toPandas()
    assert len(left) == 40 and left.v.isna().sum() == 20
    inner = joins.augmentation_join(pairs, cells, how="inner").where("side = 'query' and col = 't'").toPandas()
    assert set(inner.row_id) == set(base[base.x.notna()].r)

    own = assoc.linear(assoc.aligned(assoc.own_pairs(pairs), cells, impute=None)).toPandas()
    assert own.pearson[0] == pytest.approx(base.t.corr(base.a))
    cross = assoc.linear(assoc.aligned(pairs, cells)).toPandas()
    assert cross.n[0] == 40 and cross.pearson[0] == pytest.approx(filled.t.corr(filled.x))

    model = scores.model_rows(pairs, cells).toPandas().set_index("row_id").reindex(filled.index)
    assert np.allclose(model.y, filled.t) and np.allclose(np.stack(model.qx)[:, 0], filled.a)
    assert np.allclose(np.stack(model.cx)[:, 0], filled.x)


def test_clean_names_joins_every_page_and_part(spark, tmp_path):
    spark.createDataFrame([(1, "a[1]"), (2, "b<"), (2, "b2"), (None, "c")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(2, "p", "q"), (3, "r", "s"), (None, "t", "u")], "p_partkey long, p_name string, p_brand string").write.parquet(
        f"{tmp_path}/part.parquet")
    got = sorted((tuple(r) for r in catalogue.QUERIES["p18_clean_names"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("a[1]", "a_1_", None, None), ("b<", "b_", "p[q]<", "p_q__"), ("b2", "b2", "p[q]<", "p_q__"), ("c", "c", None, None),
                          (None, None, "r[s]<", "r_s__"), (None, None, "t[u]<", "t_u__")], key=str)


def test_cells_of_pairs_are_not_dealt_by_dataset(spark, lake):
    pairs = spark.createDataFrame([("d0", "t", "d5"), ("d0", "t", "d5"), ("d0", "u", "d9"), (None, "t", "d1")], "query_id string, target string, candidate_id string")
    got = joins.pair_cells(pairs, spark.createDataFrame(lake, CELL), "query")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    own = lake[lake.dataset_id == "d0"]
    want = sorted((*p, *r) for p in (("d0", "t", "d5"), ("d0", "t", "d5"), ("d0", "u", "d9")) for r in own[["row_key", "col", "v"]].itertuples(index=False))
    assert sorted(tuple(r) for r in got.collect()) == want
