"""Groups of links grow without going through all stars again."""

import numpy as np

from joinlift.llm import components, shingles


def groups_of(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_finished_stars_take_no_round(spark, monkeypatch):
    seen = []
    star = components._star
    monkeypatch.setattr(components, "_star", lambda *a, **k: seen.append(a) or star(*a, **k))
    links = [(1, 5), (9, 1), (2, 7), (7, 2), (4, 4), (None, 3)]
    got = components.components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()
    assert sorted(tuple(r) for r in got) == [(5, 1), (7, 2), (9, 1)]
    assert not seen
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "x long, y long")
    assert sorted(tuple(r) for r in components.components(chain, "x", "y").collect()) == [(i, 0) for i in range(1, 41)]
    assert components.components(chain.where("x < 0"), "x", "y").isEmpty()


def test_new_links_merge_groups(spark):
    rng = np.random.default_rng(4)
    for n_old, n_new in ((0, 30), (60, 1), (60, 60), (200, 40)):
        old, new = ([tuple(x) for x in rng.integers(-150, 150, (n, 2)).tolist() if x[0] != x[1]] for n in (n_old, n_new))
        nodes = sorted({n for link in old + new for n in link})
        before = components.components(spark.createDataFrame(old, "a long, b long"), "a", "b").selectExpr("node fp", "component label")
        merged = shingles._merged(before, shingles.store(spark.createDataFrame(new, "a long, b long")))
        rows = [tuple(r) for r in merged.collect()]
        assert len(rows) == len(dict(rows))
        assert {n: dict(rows).get(n, n) for n in nodes} == groups_of(nodes, old + new)
