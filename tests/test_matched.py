"""Measures from matched rows alone against the same on filled rows; joins of pairs with hot datasets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from joinlift.functions import attach, materialise, meet, spread
from joinlift.operators import assoc, joins
from joinlift.schema import PAIR


@pytest.fixture(scope="module")
def lake(spark):
    rng = np.random.default_rng(1)
    cells = []

    def add(dataset, keys, col, values):
        cells.extend((dataset, k, col, None if v is None else float(v)) for k, v in zip(keys, values))
    keys = [f"k{i}" for i in range(300)]
    y = rng.integers(0, 40, 300)
    add("q", keys, "y", y)
    add("q", keys, "z", rng.normal(size=300))
    some = keys[50:250] + [f"x{i}" for i in range(30)]
    add("c", some, "ties", np.concatenate([y[50:250] // 4 + rng.integers(0, 3, 200), np.zeros(30)]))
    add("c", some, "real", np.concatenate([y[50:250] + rng.normal(size=200), np.ones(30)]))
    add("c", some, "constant", np.full(230, 7.0))
    add("c", some, "nulls", [None] * 230)
    add("c", some, "mean", [1.0, 3.0] * 50 + [2.0] * 130)            # the mean is among the values
    add("c", some[:20] * 3, "repeated", rng.normal(size=60))          # keys three times
    add("full", keys, "whole", y * 2.0)
    add("none", ["a", "b"], "far", [1.0, 2.0])
    cells = [(*c, f"{c[1]}") for c in cells] + [("r", f"k{i % 100}", "t", float(i % 17), f"r{i}") for i in range(300)]
    frame = spark.createDataFrame(cells, "dataset_id string, row_key string, col string, v double, row_id string")
    pairs = spark.createDataFrame([("q", t, c) for t in ("y", "z") for c in ("c", "full", "none")] + [("r", "t", "c"), ("r", "t", "full")],
                                  "query_id string, target string, candidate_id string")
    return pairs, materialise(frame)


@pytest.mark.parametrize("split_rows", [None, 20])
def test_matched_rows_are_enough(spark, lake, split_rows):
    pairs, cells = lake
    rows = materialise(assoc.aligned(pairs, cells))
    want = assoc.measures(rows).toPandas().set_index([*PAIR, "col"]).sort_index()
    of = assoc.match(pairs, cells, split_rows=split_rows)
    kw = {} if split_rows is None else dict(split_rows=split_rows)
    got = assoc.matched_linear(of).join(assoc.matched_spearman(of, **kw), [*PAIR, "col"]).join(
        assoc.matched_information(of), [*PAIR, "col"]).toPandas().set_index([*PAIR, "col"]).sort_index()
    assert list(got.index) == list(want.index) and len(got) == 2 * 8 + 7
    for c in ("n", "pearson", "covariance", "spearman", "mutual_info"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1e-9), c
    light = assoc.matched_linear(assoc.match(pairs, cells, ranks=False)).toPandas().set_index([*PAIR, "col"]).sort_index()
    assert np.allclose(light["pearson"], want["pearson"], atol=1e-12)


def test_pairs_meet_rows_in_both_ways(spark, lake, monkeypatch):
    pairs, cells = lake
    keys = [tuple(r) for r in joins.containment(pairs, cells).collect()]
    joined = sorted(map(str, joins.augmentation_join(pairs, cells.drop("row_id").where("dataset_id <> 'r'")).collect()))
    monkeypatch.setattr(spread, "FEW_ROWS", 1)
    assert sorted(keys, key=str) == sorted((tuple(r) for r in joins.containment(pairs, cells).collect()), key=str)
    assert joined == sorted(map(str, joins.augmentation_join(pairs, cells.drop("row_id").where("dataset_id <> 'r'")).collect()))
    few = materialise(pairs.select("candidate_id").distinct())
    rows = cells.withColumnRenamed("dataset_id", "candidate_id")
    for how in ("inner", "left_semi"):
        assert meet(rows, few, ["candidate_id"], ["row_key"], how).count() == rows.join(few, "candidate_id", how).count()
