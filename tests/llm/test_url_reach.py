"""Distrust in the URL filter neither fades with the size of the corpus nor ends after some links."""

import numpy as np

from joinlift.llm import url_graph

RULES = (("com/", "allow"), ("net/", "block"))


def link(host):
    return f'<a href="http://{host}/">x</a>'


def test_distrust_reaches_every_host_upstream(spark, monkeypatch):
    monkeypatch.setattr(url_graph, "TOLERANCE", 0.05)          # fewer rounds; the reach does not hang on it
    far = [(i, f"http://c{i}.org/", link(f"c{i + 1}.org") if i < 13 else link("bad.net")) for i in range(14)]
    pages = [*far, (100, "http://bad.net/", ""), (101, "http://free.org/", link("good.com")), (102, "http://good.com/", link("free.org"))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_graph.judge(frame, RULES).collect()}
    assert [got[i] for i in range(14)] == ["block"] * 14
    assert (got[100], got[101], got[102]) == ("block", "allow", "allow")


def test_a_seed_of_small_mass_blocks_all_that_link_to_it(spark, monkeypatch):
    monkeypatch.setattr(url_graph, "TOLERANCE", 0.05)
    # a thousand one-page hosts upstream of a seed that holds one of 1,000,001 blocked pages
    pages = [(i, f"http://h{i}.org/", link("small.net")) for i in range(1000)] + [(5000, "http://small.net/", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").unionByName(
        spark.range(1_000_000).selectExpr("id + 10000 as page_id", "'http://hot.net/' as url", "cast(null as string) as html"))
    assert url_graph.judge(frame, RULES).where("page_id < 1000 and verdict = 'block'").count() == 1000


def test_a_graph_of_a_hundred_thousand_edges_agrees_with_a_power_iteration(spark):
    rng = np.random.default_rng(3)
    n = 3_000
    names = [f"h{i}." + ("com" if i < 60 else "net" if i < 120 else "org") for i in range(n)]
    popular = (n * rng.random((n, 36)) ** 3).astype(int)               # few hosts get most of the links
    to = [sorted({int(j) for j in js[:0 if i % 10 == 9 else 36]} - {i}) for i, js in enumerate(popular)]
    pages = [(i, f"http://{h}/", "".join(link(names[j]) for j in to[i])) for i, h in enumerate(names)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [r["verdict"] for r in url_graph.judge(frame, RULES).orderBy("page_id").collect()]

    a = np.zeros((n, n))
    for i, js in enumerate(to):
        a[i, js] = 1
    assert a.sum() > 90_000

    def rank(a, seeds):
        step = a / np.maximum(a.sum(1, keepdims=True), 1) * url_graph.DAMPING
        seed = score = seeds / seeds.sum()
        for _ in range(200):
            moved = score @ step
            score = moved + seed * (1 - moved.sum())
        return score

    i = np.arange(n)
    trust, distrust = rank(a, (i < 60) * 1.0), rank(a.T, ((i >= 60) & (i < 120)) * 1.0)
    clear = (i >= 120) & (np.abs(trust - distrust) > 1e-5)
    want = np.where(distrust > trust, "block", "allow")
    assert clear.sum() > 2_000 and len(set(want[clear])) == 2
    assert (np.array(got)[clear] == want[clear]).all()
    assert set(got[:60]) == {"allow"} and set(got[60:120]) == {"block"}
