"""Ordered helpers against pandas, on the plain path and on the range-splitting path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from joinlift.functions import average_ranks, cumulate, group_median, hash_order, positions
from joinlift.functions.spread import attach


@pytest.fixture(scope="module")
def table():
    """One group with most of the rows, small ones, and many ties."""
    rng = np.random.default_rng(1)
    g = np.where(rng.random(4000) < 0.7, "hot", rng.choice(list("abcde"), 4000))
    v = np.round(rng.normal(size=4000), 1)
    return pd.DataFrame({"g": g, "k": np.arange(4000), "v": v})


SPLIT = [dict(), dict(split_rows=100, slots=16)]


@pytest.mark.parametrize("kw", SPLIT)
def test_positions_follow_the_total_order(spark, table, kw):
    got = positions(spark.createDataFrame(table), ["g"], ["v", "k"], **kw).toPandas()
    want = table.sort_values(["g", "v", "k"])
    want["pos"] = want.groupby("g").cumcount()
    want["pos_total"] = want.groupby("g")["k"].transform("size")
    both = got.merge(want, on=["g", "k", "v"], suffixes=("", "_w"))
    assert len(both) == len(table)
    assert (both["pos"] == both["pos_w"]).all() and (both["pos_total"] == both["pos_total_w"]).all()


@pytest.mark.parametrize("kw", SPLIT)
def test_positions_without_a_group(spark, table, kw):
    got = positions(spark.createDataFrame(table), [], ["v", "k"], **kw).toPandas().sort_values("pos")
    want = table.sort_values(["v", "k"])
    assert list(got["k"]) == list(want["k"]) and list(got["pos"]) == list(range(len(table)))


@pytest.mark.parametrize("kw", SPLIT)
def test_running_sums(spark, table, kw):
    df = spark.createDataFrame(table)
    got = cumulate(df, ["g"], ["k"], {"s": F.col("k")}, **kw).toPandas()
    want = table.sort_values("k")
    want["s"] = want.groupby("g")["k"].cumsum() - want["k"]
    both = got.merge(want, on=["g", "k"], suffixes=("", "_w"))
    assert (both["s"] == both["s_w"]).all()


@pytest.mark.parametrize("kw", SPLIT)
def test_average_ranks_share_ties(spark, table, kw):
    counts = spark.createDataFrame(table).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    got = average_ranks(counts, ["g"], "v", "c", **kw).toPandas()
    want = table.assign(r=table.groupby("g")["v"].rank(method="average")).groupby(["g", "v"])["r"].first()
    both = got.set_index(["g", "v"])["rank"]
    assert np.allclose(both.sort_index(), want.sort_index())


@pytest.mark.parametrize("kw", SPLIT)
def test_exact_medians(spark, table, kw):
    got = group_median(spark.createDataFrame(table), ["g"], "v", **kw).toPandas().set_index("g")["median"]
    assert np.allclose(got.sort_index(), table.groupby("g")["v"].median().sort_index())


def test_hash_order_is_a_permutation_and_repeats(spark, table):
    df = spark.createDataFrame(table)
    a = hash_order(df, ["g"], ["k"], seed="s").select("k", "pos").toPandas().sort_values("k")
    b = hash_order(df.repartition(7), ["g"], ["k"], seed="s").select("k", "pos").toPandas().sort_values("k")
    assert (a["pos"].to_numpy() == b["pos"].to_numpy()).all()
    per = a.merge(table, on="k").groupby("g")["pos"].apply(lambda p: sorted(p) == list(range(len(p))))
    assert per.all()


def test_attach_keeps_every_row_once(spark, table):
    df = spark.createDataFrame(table)
    stats = df.groupBy("g").agg(F.avg("v").alias("m")).where("g <> 'a'")
    left = attach(df, stats, ["g"], ["k"]).toPandas()
    assert len(left) == len(table) and left.loc[left.g == "a", "m"].isna().all()
    assert left.loc[left.g != "a", "m"].notna().all()


def test_no_window_sees_a_whole_large_group(spark, table):
    """On the splitting path every window that sorts rows is partitioned by range as well."""
    out = positions(spark.createDataFrame(table), ["g"], ["v", "k"], split_rows=100, slots=16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Window" in line and "v#" in line.split("[")[-1]]
    assert all("__range" in line for line in sorts)
