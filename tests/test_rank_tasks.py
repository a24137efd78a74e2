"""Rankings of small groups: tasks that follow the rows, no row repeated per list, Kendall in tasks."""

import numpy as np
import pandas as pd
import pytest

from joinlift.functions import spread
from joinlift.operators import assoc, rank, select


def pairs(n_queries=4, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(n_queries):
        for c in range(int(rng.integers(1, 90))):
            gain, p = round(float(rng.normal()), 1), float(rng.random())
            rows.append((f"q{q}", "t", f"c{c}", gain, round(gain + float(rng.normal()), 1), round(float(rng.random()), 2),
                         round(float(rng.normal()), 2), p, "gain" if p > 0.5 else "loss", "gain" if gain > 0 else "loss"))
    return pd.DataFrame(rows, columns=["query_id", "target", "candidate_id", "gain", "predicted_gain", "containment",
                                       "pearson_difference", "p_gain", "pred_class", "class"])


REPORT = {"model": "predicted_gain", "containment": "containment", "pearson": "pearson_difference"}


def same(a, b, keys):
    a, b = (d.toPandas().set_index(keys).sort_index() for d in (a, b))
    assert len(a) == len(b) > 0
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False, atol=1e-10)


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "TASK_ROWS", 10)
    table = pairs()
    ranked = rank.rank_candidates(spark.createDataFrame(table), {"real_rank": "gain"})
    assert ranked.rdd.getNumPartitions() >= len(table) // 10
    assert ranked.count() == len(table)


def test_curves_agree_with_the_way_for_large_groups(spark):
    rows = spark.createDataFrame(pairs())
    same(rank.retrieval_curves(rows), rank.retrieval_curves(rows, split_rows=40, slots=2), ["recipe", "k"])


def test_report_and_curves_repeat_no_row_per_list(spark, monkeypatch):
    """Rows go through one ranking shuffle: nothing is ranked list by list."""
    def refuse(*a, **kw):
        raise AssertionError("ranked list by list")
    monkeypatch.setattr(rank, "rank_by", refuse)
    rows = spark.createDataFrame(pairs())
    assert rank.ranking_report(rows, REPORT).count() == 3
    assert rank.retrieval_curves(rows).count() == 8 * 51


def test_kendall_in_tasks_counts_ties_and_weights(spark, monkeypatch):
    rng = np.random.default_rng(5)
    table = pd.DataFrame(dict(g=rng.integers(0, 4, 300), x=rng.integers(0, 9, 300).astype(float), y=rng.normal(size=300).round(1)))
    table = pd.concat([table, pd.DataFrame(dict(g=[9] * 5, x=[1.0] * 5, y=[1.0, 2, 3, 4, 5]))])
    table.loc[:10, "x"] = np.nan                                      # one value, above all others
    sdf = spark.createDataFrame(table)
    joint = assoc.joint_counts(sdf, ["g"])
    slow = assoc.kendall(joint, ["g"], split_rows=20, slots=4).toPandas().set_index("g").kendall
    monkeypatch.setattr(assoc, "discordant_pairs", lambda *a, **kw: pytest.fail("digit by digit"))
    fast = assoc.kendall(joint, ["g"]).toPandas().set_index("g").kendall
    assert fast[9] == 0.0 and fast.sort_index().to_numpy() == pytest.approx(slow.sort_index().to_numpy())


def test_harmonic_numbers(spark):
    ks = [0, 1, 2, 31, 32, 33, 1000, 100_000]
    from pyspark.sql import functions as F
    got = [r[0] for r in spark.createDataFrame([(k,) for k in ks], "k long").select(rank.harmonic(F.col("k"))).collect()]
    assert got == pytest.approx([sum(1 / i for i in range(1, k + 1)) for k in ks], rel=1e-14)


@pytest.mark.parametrize("group", [["g"], ["g", "h"], []])
def test_median_of_large_groups_orders_the_middle_only(spark, monkeypatch, group):
    def refuse(*a, **kw):
        raise AssertionError("all values ordered")
    monkeypatch.setattr(spread, "_in_ranges", refuse)
    rng = np.random.default_rng(7)
    table = pd.DataFrame(dict(g=rng.integers(0, 3, 4000).astype(str), h=1, v=rng.normal(size=4000)))
    got = spread.group_median(spark.createDataFrame(table), group, "v", split_rows=100).toPandas()
    if not group:
        assert got["median"].tolist() == [table.v.median()]
    else:
        assert got.set_index("g")["median"].to_dict() == pytest.approx(table.groupby("g").v.median().to_dict())


def test_median_where_a_bracket_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(spread, "_near_middle", lambda *a: None)
    v = list(np.arange(301.0))
    assert spread.group_median(spark.createDataFrame([(float(x),) for x in v], "v double"), [], "v", split_rows=100, slots=4).first()[0] == 150.0


def test_bins_are_looked_up_not_joined_by_value(spark):
    """A value that fills a column is no key of a join; bins are those of the average ranks."""
    rng = np.random.default_rng(8)
    n = 600
    table = pd.DataFrame(dict(col="a", x=np.where(rng.random(n) < 0.7, 5.0, rng.normal(size=n).round(1)), y=rng.normal(size=n).round(1)))
    table.loc[::50, "x"] = None
    sdf = spark.createDataFrame([(c, None if x != x else float(x), float(y)) for c, x, y in table.itertuples(index=False)], "col string, x double, y double")
    out = select.binned(sdf, 8)
    assert "[x#" not in "".join(l for l in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in l)
    got = {(r["bx"], r["by"]): r["c"] for r in out.collect()}
    def bins(v):
        return np.floor((pd.Series(v).rank(method="average", na_option="top") - 0.5) * 8 / n)
    bx, by = bins(table.x), bins(table.y)
    want = {}
    for a, b, x in zip(bx, by, table.x):
        if x == x:
            want[int(a), int(b)] = want.get((int(a), int(b)), 0) + 1
    assert got == want
