"""Whitening against numpy's own eigenvalues; counts against them too."""

import math

import numpy as np
import pytest

from joinlift.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)


def whitened(spark, rows, **kw):
    return whitening.whiten(frame(spark, rows), **kw).collect()


def check(rows, got, k=4, scale=256):
    """Holds results against the closed formulas on the fit list."""
    by_width = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) and abs(x * scale) < 2 ** 63 for x in v):
            by_width.setdefault(len(v), []).append((i, tuple(math.floor(scale * x) for x in v)))
    want = 0
    for width, own in by_width.items():
        fit = [list(x) for x in sorted({x for _, x in own})]
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        z = np.array([[(n * c - t) for c, t in zip(x, s)] for x in fit], float) / n
        v = z.T @ z / n
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1], vectors[:, ::-1]
        live = [j for j in range(min(k, width)) if values[j] > 1e-10 * max(values[0], 1e-300)]
        mine = [r for r in got if r["n"] == n]
        assert len(mine) == len(own) * len(live)
        want += len(mine)
        place = {}
        for i, x in own:
            place.setdefault(i, []).append(x)
        for j in live:
            col = [r for r in mine if r["component"] == j + 1]
            gap = min([abs(values[j] - values[m]) for m in range(width) if m != j], default=1) > 1e-6 * values[0]
            sign = 0
            for r in col:
                assert r["explained"] == pytest.approx(values[j] / np.trace(v), rel=1e-9)
                assert r["identity_error"] < 1e-6
                fits = []
                for x in place[r["vec_id"]]:
                    d = [n * c - t for c, t in zip(x, s)]
                    dev = sum(c * c for c in d)
                    fits.append((dev if dev < 2 ** 63 else None, np.array(d, float) / n @ vectors[:, j] / math.sqrt(values[j])))
                near = [w for dev, w in fits if dev == r["deviation"]]
                assert near
                if gap and len(fits) == 1 and abs(near[0]) > 1e-3:
                    sign = sign or math.copysign(1, near[0] * r["whitened"])
                    assert r["whitened"] == pytest.approx(sign * near[0], rel=1e-7, abs=1e-7)
    assert want == len(got)


ODD = [(1000, None), (1001, []), (1002, [math.nan] * 6), (1003, [None] * 6), (1004, [math.inf] + [0.0] * 5), (None, [0.5, 1.0, 2.0, 0.0, 3.0, 4.0]),
       (1005, [1e300] * 6)]


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6)) * [5, 3, 2, 1, 1, 0.5] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000 + i, rows[0][1]) for i in range(400)] + rows[:5]          # one vector nearly half of all rows
    check(rows + ODD, whitened(spark, rows + ODD))


def test_far_from_the_origin_and_beyond_32_bits(spark):
    rng = np.random.default_rng(2)
    x = 1e9 + rng.normal(size=(200, 5)) * [4, 3, 2, 1, 0.5]
    check([(i, v.tolist()) for i, v in enumerate(x)], whitened(spark, [(i, v.tolist()) for i, v in enumerate(x)]))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.integers(-2 ** 40, 2 ** 40, (50, 3)))]
    got = whitened(spark, rows)
    assert all(r["deviation"] is None for r in got)
    check(rows, got)


def test_fewer_components_than_asked_for(spark):
    rng = np.random.default_rng(3)
    line = [(i, [float(t), 2.0 * t, -float(t)]) for i, t in enumerate(rng.integers(-50, 50, 80).tolist())]
    check(line, whitened(spark, line))
    assert {r["component"] for r in whitened(spark, line)} == {1}
    for rows in ([], ODD[:5], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitened(spark, rows) == []


def test_widths_are_fits_of_their_own(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 4)) * [4, 3, 2, 1])]
    rows += [(500 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(70, 2)) * [4, 1])]
    check(rows, whitened(spark, rows))


def test_inertia_counts_positive_eigenvalues():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 30):
        for _ in range(40):
            a = rng.normal(size=(n, n))
            a = a + a.T
            if rng.random() < 0.3:
                a[np.diag_indices(n)] = 0
            assert whitening.inertia(a) == (np.linalg.eigvalsh(a) > 0).sum()
    assert whitening.inertia(np.zeros((5, 5))) == 0


@pytest.mark.parametrize("values", [
    [9, 7, 5, 3, 1, 0.5], [4, 4, 4, 4, 4, 1], [3, 3, 2, 2, 1, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0, 0], [5, 0, 0, 0, 0, 0],
    [1e12, 1e6, 1, 1e-3, 0, 0], [2, 1, 1, 1, 1, 1]])
def test_leading_pairs(values):
    q = np.linalg.qr(np.random.default_rng(6).normal(size=(6, 6)))[0]
    v = q * values @ q.T
    v = (v + v.T) / 2
    got, vectors = whitening.leading(v, 4)
    live = [x for x in values if x > 1e-12 * values[0]][:4]
    assert len(got) >= min(len([x for x in values if x > 1e-10 * values[0]]), 4)
    assert got[:len(live)] == pytest.approx(live, rel=1e-9, abs=1e-13 * values[0])
    assert np.abs(vectors @ vectors.T - np.eye(len(got))).max() < 1e-12
    assert np.abs(v @ vectors.T - vectors.T * got).max() < 1e-11 * values[0]


def test_wide_covariance():
    x = np.random.default_rng(7).normal(size=(1000, 256)) * np.linspace(3, 1, 256)
    v = x.T @ x / 1000
    got, vectors = whitening.leading(v, 4)
    assert got == pytest.approx(np.linalg.eigvalsh(v)[::-1][:4], rel=1e-12)
