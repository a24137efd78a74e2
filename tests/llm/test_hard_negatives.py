"""Hard negatives against brute force over Python's whole numbers."""

import math
from collections import defaultdict

import numpy as np
import pytest

from joinlift.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score double, grp int, anchor_id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 0.5, 3, 9) for i, v, label in rows], SCHEMA)


def plain(rows, every, positives, negatives, scale=256, window=(30, 90)):
    own = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(scale * c) for c in v]
        if sum(c * c for c in x) >= 2 ** 62:
            continue
        own[i] = min(own.get(i, (label, x)), (label, x))
    out = set()
    for a, (la, x) in own.items():
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), j, lb) for j, (lb, y) in own.items() if j != a and len(y) == len(x)]
        best = sorted(s for s in scores if s[2] == la)[:positives]
        for ps, p, _ in best:
            fit = sorted(s for s in scores if s[2] != la and window[0] * -ps <= 100 * -s[0] <= window[1] * -ps)
            out |= {(a, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(fit[:negatives])}
    return out


def mined(spark, rows, every, **kw):
    got = hard_negatives.mine(frame(spark, rows), lambda i: i % every == 0, **kw).collect()
    found = [tuple(r) for r in got]
    assert len(found) == len(set(found))
    return set(found)


ODD = [(1000, None, 1), (1010, [], 1), (1020, [math.nan] * 6, 1), (1030, [None] * 6, 1), (1040, [math.inf] + [0.0] * 5, 2),
       (None, [1.0] * 6, 1), (1050, [1.0] * 6, None), (1060, [0.5, 0.25], 2), (1061, [0.5, 0.5], 2), (1062, [0.25, 0.25], 1), (1070, [1e300] * 6, 1)]


@pytest.mark.parametrize("shard_rows,tile_anchors", [(8192, 512), (37, 5), (3, 2)])
def test_against_brute_force(spark, shard_rows, tile_anchors):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(320, 6)).round(1)                       # rounding makes ties
    rows = [(i, v.tolist(), int(rng.integers(0, 9) ** 2 / 20)) for i, v in enumerate(x)]     # one label holds half of all rows
    rows += [(400 + i, [0.3] * 6, i % 3) for i in range(60)]     # one vector many times
    rows += rows[:9] + [(5, [2.0] * 6, 0)] + ODD
    want = plain(rows, 10, 5, 10)
    assert mined(spark, rows, 10, shard_rows=shard_rows, tile_anchors=tile_anchors) == want
    assert len(want) > 500


def test_scores_far_beyond_float32_and_double(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.integers(-2 ** 28, 2 ** 28, 40)], i % 2) for i in range(60)]
    want = plain(rows, 5, 3, 4, scale=1)
    assert max(abs(r[4]) for r in want) > 2 ** 53
    assert mined(spark, rows, 5, positives=3, negatives=4, scale=1) == want


def test_products_of_wide_vectors_are_exact():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-2 ** 24, 2 ** 24, (7, 3000)), rng.integers(-2 ** 24, 2 ** 24, (9, 3000))
    primes = hard_negatives.moduli(2 ** 62)
    got = hard_negatives.Residues(a, primes).scores(hard_negatives.Residues(b, primes))
    assert (got == a @ b.T).all()
    # every residue at its largest
    c = np.full((1, 5000), 125)
    assert hard_negatives.Residues(c, primes).scores(hard_negatives.Residues(-c, primes))[0, 0] == -5000 * 125 ** 2


def test_every_number_has_its_remainders():
    primes = hard_negatives.moduli(30_000)
    x = np.arange(-30_000, 30_001)[None, :]
    assert (hard_negatives.reconstruct([hard_negatives.balanced(x.astype(np.int32), p) for p in primes], primes) == x).all()


def test_small_tables(spark):
    for rows in ([], ODD[:7], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [-1.0], 1), (2, [0.5], 2)]):
        assert mined(spark, rows, 10) == plain(rows, 10, 5, 10) == set()
    # a positive of score 0 takes negatives of score 0
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 3.0], 2)]
    assert mined(spark, rows, 10) == {(0, 1, 1, 2, 0, 0)}


def test_lists_have_gapless_ranks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(rng.normal(size=(200, 5)))]
    ranks = defaultdict(list)
    for a, p, r, *_ in mined(spark, rows, 20):
        ranks[a, p].append(r)
    assert ranks and all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())
