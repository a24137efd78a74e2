"""Labelling policies and ranking measures against loops over small random tables."""

import math

import numpy as np
import pandas as pd
import pytest

from joinlift.operators import labels, rank


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    rows = []
    for q in range(12):
        n = int(rng.integers(1, 30)) if q else 80
        for c in range(n):
            gain = float(np.round(rng.normal() * 10.0 ** rng.integers(-2, 2), 2))
            rows.append((f"q{q}", "t", f"c{c:03d}", gain, float(np.round(rng.normal(), 1)),
                         float(rng.random()), float(rng.random())))
    out = pd.DataFrame(rows, columns=["query_id", "target", "candidate_id", "gain", "predicted_gain",
                                      "p_gain", "containment"])
    out["pearson_difference"] = np.round(rng.normal(size=len(out)), 1)
    out["class"] = np.where(out.gain > 0, "gain", "loss")
    out["pred_class"] = np.where(out.p_gain > 0.5, "gain", "loss")
    return out


def walk_down(steps, drops):
    """Position of the drops-th fall met from the top; the last met when there are fewer."""
    position, seen, above = -1, 0, -math.inf
    for i in range(len(steps) - 1, -1, -1):
        if steps[i] < above:
            position, seen = i, seen + 1
            if seen == drops:
                return position
        above = steps[i]
    return position


@pytest.mark.parametrize("kw", [dict(), dict(chunk=4, split_rows=20, slots=4)])
def test_policies(spark, table, kw):
    got = labels.all_policies(spark.createDataFrame(table), **kw).toPandas()
    assert len(got) == len(table)
    for _, part in got.groupby("query_id"):
        part = part.sort_values(["gain", "candidate_id"]).reset_index(drop=True)
        g = part.gain.to_numpy()
        steps = [-math.inf, *np.diff(g)]
        size = [-math.inf if v == 0 else math.floor(math.log10(abs(v))) for v in g]
        below = [i for i in range(len(g)) if size[i] < size[-1]]
        cuts = {"harsh_grad_class": walk_down(steps, 1), "2th_grad_drop_class": walk_down(steps, 2),
                "order_of_mag_drop_class": below[-1] if below else -1,
                "median_based_class": math.ceil(len(g) / 2)}
        for name, cut in cuts.items():
            want = ["gain" if i > cut and g[i] > 0 else "loss" for i in range(len(g))]
            assert list(part[name]) == want, name
        assert (part.loc[part.harsh_grad_class == "gain", "class_pos_neg"] == "gain").all()


def test_mean_and_median_classes(spark, table):
    got = labels.by_query_average(spark.createDataFrame(table)).toPandas()
    by = table.groupby("query_id").gain
    for name, stat in (("class_mean", by.mean()), ("class_median", by.median())):
        want = np.where((got.gain > got.query_id.map(stat)) & (got.gain > 0), "gain", "loss")
        assert (got[name] == want).all()


def orders(part):
    real = list(part.sort_values(["gain", "candidate_id"], ascending=[False, True]).candidate_id)
    pred = list(part.sort_values(["predicted_gain", "candidate_id"], ascending=[False, True]).candidate_id)
    return real, pred


@pytest.mark.parametrize("kw", [dict(), dict(split_rows=20, slots=4)])
def test_ranking_measures(spark, table, kw):
    ranked = rank.rank_candidates(spark.createDataFrame(table), {
        "real_rank": "gain", "pred_rank": "predicted_gain"}, **kw).cache()
    one = lambda df: df.toPandas().set_index("query_id").iloc[:, -1]
    ap = one(rank.average_precision(ranked, **kw))
    tau = one(rank.kendall_of_rankings(ranked, **kw))
    mrr, ndcg = one(rank.reciprocal_rank(ranked)), one(rank.ndcg(ranked))
    rp, p5 = one(rank.r_precision(ranked)), one(rank.precision_at(ranked, 5))
    for q, part in table.groupby("query_id"):
        real, pred = orders(part)
        n = len(real)
        assert ap[q] == pytest.approx(np.mean([len(set(real[:k]) & set(pred[:k])) / k for k in range(1, n + 1)]))
        assert mrr[q] == pytest.approx(1 / (pred.index(real[0]) + 1))
        assert p5[q] == pytest.approx(len(set(real[:5]) & set(pred[:5])) / 5)
        rel = {c: min(5, n) - i for i, c in enumerate(real[:5])}
        found = [rel.get(c, 0) for c in pred]
        dcg = lambda r: sum(v / math.log2(i + 2) for i, v in enumerate(r))
        assert ndcg[q] == pytest.approx(dcg(found) / dcg(sorted(found, reverse=True)))
        good = set(part[part.gain > 0].candidate_id)
        if good:
            assert rp[q] == pytest.approx(len(good & set(pred[:len(good)])) / len(good))
        else:
            assert pd.isna(rp[q])
        if n > 1:
            at = np.array([pred.index(c) for c in real])
            s = np.sign(at[:, None] - at[None]) * np.sign(np.arange(n)[:, None] - np.arange(n)[None])
            assert tau[q] == pytest.approx(s.sum() / (n * (n - 1)))


def test_retrieval_curves(spark, table):
    got = rank.retrieval_curves(spark.createDataFrame(table)).toPandas().set_index(["recipe", "k"])
    want = {}
    for _, part in table.groupby("query_id"):
        true = part[part["class"] == "gain"].sort_values(["gain", "candidate_id"], ascending=[False, True])
        said = part[part.pred_class == "gain"]
        if not len(true) or not len(said) or not (said.p_gain > 0.6).any():
            continue
        ranked = list(said.sort_values(["containment", "candidate_id"], ascending=[False, True]).candidate_id)
        for k in (0, 1, 3, 10):
            top, over = ranked[:k], list(true[true.gain > 1].candidate_id)[:k]
            hits = len(set(top) & set(true.candidate_id))
            best = ranked[:len(over)]
            want.setdefault(k, []).append((
                hits / len(top) if top else np.nan, hits / len(true) if top else np.nan,
                len(set(over) & set(best)) / len(best) if best else np.nan,
                len(set(list(true.candidate_id)[:k]) & set(top)) / len(top) if top else np.nan))
    for k, rows in want.items():
        row = got.loc[("classifier_containment", k)]
        means = pd.DataFrame(rows).mean()
        for name, value in zip(("precision", "recall", "strict_r_precision", "r_recall"), means):
            assert (pd.isna(row[name]) and pd.isna(value)) or row[name] == pytest.approx(value)
