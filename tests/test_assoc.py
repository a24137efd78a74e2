"""Association measures against direct restatements."""

import numpy as np
import pandas as pd
import pytest

from joinlift.operators import assoc

G = ["g"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    frames = []
    for g, n in (("hot", 400), ("b", 60), ("c", 5)):
        x = np.round(rng.normal(size=n), 1)
        frames.append(pd.DataFrame({"g": g, "x": x, "y": np.round(x * 0.5 + rng.normal(size=n), 1)}))
    frames.append(pd.DataFrame({"g": "flat", "x": [2.0] * 9, "y": np.arange(9.0)}))
    frames.append(pd.DataFrame({"g": "one", "x": [1.0], "y": [2.0]}))
    return pd.concat(frames, ignore_index=True)


def tau_b(x, y):
    a, b = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    scale = np.sqrt((a != 0).sum() * (b != 0).sum())
    return (a * b).sum() / scale if scale else 0.0


def nmi(x, y):
    n = len(x)
    def h(*cols):
        c = pd.DataFrame(dict(enumerate(cols))).value_counts().to_numpy() / n
        return -(c * np.log(c)).sum(), len(c)
    (hx, kx), (hy, ky), (hxy, _) = h(x), h(y), h(x, y)
    if kx == 1 and ky == 1:
        return 1.0
    return 0.0 if kx == 1 or ky == 1 else (hx + hy - hxy) / np.sqrt(hx * hy)


SPLIT = [dict(), dict(split_rows=50, slots=8)]


@pytest.mark.parametrize("kw", SPLIT)
def test_kendall(spark, table, kw):
    joint = assoc.joint_counts(spark.createDataFrame(table), G)
    got = assoc.kendall(joint, G, **kw).toPandas().set_index("g")["kendall"]
    for g, part in table.groupby("g"):
        assert got[g] == pytest.approx(tau_b(part.x.to_numpy(), part.y.to_numpy()), abs=1e-12)


@pytest.mark.parametrize("kw", SPLIT)
def test_spearman(spark, table, kw):
    joint = assoc.joint_counts(spark.createDataFrame(table), G)
    got = assoc.spearman(joint, G, **kw).toPandas().set_index("g")["spearman"]
    for g, part in table.groupby("g"):
        want = part.x.rank().corr(part.y.rank())
        assert got[g] == pytest.approx(0.0 if np.isnan(want) else want, abs=1e-12)


def test_linear_and_information(spark, table):
    df = spark.createDataFrame(table)
    lin = assoc.linear(df, G).toPandas().set_index("g")
    info = assoc.normalised_mutual_information(assoc.joint_counts(df, G), G).toPandas().set_index("g")
    for g, part in table.groupby("g"):
        r = part.x.corr(part.y)
        assert lin.pearson[g] == pytest.approx(0.0 if np.isnan(r) else r, abs=1e-12)
        assert info.mutual_info[g] == pytest.approx(nmi(part.x, part.y), abs=1e-9)
        assert -1e-12 <= info.mutual_info[g] <= 1 + 1e-12


def _lake(spark):
    rows = [("q", str(i), "t", float(i)) for i in range(10)] + [("q", str(i), "f", float(i * i)) for i in range(10)]
    rows += [("c", str(i), "a", float(-i)) for i in range(5)] + [("c", "x", "a", 99.0), ("c", "9", "b", 3.0)]
    rows += [("far", "zz", "a", 1.0)]
    cells = spark.createDataFrame(rows, "dataset_id string, row_key string, col string, v double")
    pairs = spark.createDataFrame([("q", "t", "c"), ("q", "t", "far")],
                                  "query_id string, target string, candidate_id string")
    return pairs, cells


def test_alignment_imputes_the_mean_of_matched_rows(spark):
    rows = assoc.aligned(*_lake(spark)).toPandas()
    assert len(rows) == 30   # three candidate columns on ten query rows
    a = rows[(rows.candidate_id == "c") & (rows.col == "a")].set_index("row_key").x
    assert a["4"] == -4.0 and a["7"] == -2.0
    assert (rows[(rows.candidate_id == "c") & (rows.col == "b")].x == 3.0).all()
    assert (rows[rows.candidate_id == "far"].x == 0.0).all()


def test_alignment_of_matched_rows_only(spark):
    rows = assoc.aligned(*_lake(spark), impute=None).toPandas()
    assert len(rows) == 6 and set(rows.candidate_id) == {"c"}


def test_a_repeated_key_is_averaged(spark):
    pairs, cells = _lake(spark)
    twice = cells.unionByName(spark.createDataFrame([("c", "4", "a", -8.0)], cells.schema))
    rows = assoc.aligned(pairs, twice).toPandas()
    assert len(rows) == 30
    assert rows[(rows.candidate_id == "c") & (rows.col == "a") & (rows.row_key == "4")].x.item() == -6.0


def test_column_pairs_inside_a_dataset(spark):
    _, cells = _lake(spark)
    rows = assoc.within_dataset(cells.where("dataset_id = 'q'")).toPandas()
    assert len(rows) == 10 and set(zip(rows.col_a, rows.col_b)) == {("f", "t")}
    many = spark.range(130).selectExpr("'w' dataset_id", "'k' row_key", "concat('c', id) col", "double(id) v")
    assert assoc.within_dataset(many).count() == 130 * 129 // 2
