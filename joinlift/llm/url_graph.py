"""URL filter: rules first, then link-graph propagation over host edges.

Rules decide the addresses that they cover. For all others, trust flows from trusted hosts along links and distrust flows from
blocked hosts against them (who links to a blocked host is suspect), both as personalised PageRank; a host whose
distrust exceeds ``THRESHOLD`` times its trust is blocked. There is no absolute floor, so any distrust without trust blocks.

Rounds go on until all that later ones could add is at most ``TOLERANCE`` of a kind's whole mass and no further host was
reached in the last ``STORE_EVERY`` of them, however far it is from a seed. Each kind's scores sum to one.

A host is a seed when the rules decide more than half of its pages one way; its weight is the number of those pages.
Host edges are the distinct pairs of a page's host and the host of an absolute link in its HTML, weighted by
the number of links; links within a host carry nothing. Mass at hosts without edges returns to the seeds.

Everything is built from DataFrame functions. Defined cases: a null address, or one without ``://``, has an empty host and path and
the method's verdict for a host that nothing reaches, allow. Null HTML has no links. Repeated rows get equal answers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinlift.llm.common import lookup_join, store

ALLOW, BLOCK = "allow", "block"
DAMPING = 0.85
ROUNDS = 10                # at least so many
STORE_EVERY = 5            # rounds between written tables, so that lineage stays short
TOLERANCE = 1e-6
THRESHOLD = 1.0

#: The links of a page that name a host.
LINK = r"(?i)href\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.substring(url, found + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return (F.when(found > 0, lower_ascii(host)).otherwise(""), F.when(found > 0, path).otherwise(""))


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (``host/path``) that covers an address, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):      # a longer rule, tried later, overrides
        top, slash, rest = rule.partition("/")
        fits = ((host == top) | F.endswith(host, F.lit("." + top))) & F.startswith(path, F.lit(slash + rest))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, links): links between different hosts, summed before the shuffle."""
    links = F.regexp_extract_all(F.col(html), F.lit(LINK), 1)
    return (pages.select(F.col(host).alias("src"), F.explode(links).alias("dst"))
            .select("src", lower_ascii(F.regexp_replace("dst", r"^.*@|:\d*$", "")).alias("dst"))
            .where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links")))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score): personalised PageRank per kind. ``edges``: (kind, src, dst, links); ``seeds``: (kind, host, mass).

    A round sends each host's ``fresh`` mass (what reached it in the round before) over its links, damped, and adds what
    arrives to its ``mass``. The sum over all rounds, scaled to one, is the score: mass that returns to the seeds only
    repeats it. Each host has a row of its own among its links, which carries its mass, so a round reads its state once.
    """
    total = seeds.groupBy("kind").agg(F.sum("mass").alias("all"))          # one row per kind: two
    state = seeds.join(F.broadcast(total), "kind").select(
        "kind", "host", (F.col("mass") / F.col("all")).alias("fresh"), (F.col("mass") / F.col("all")).alias("mass"))
    out = edges.groupBy("kind", "src").agg(F.sum("links").alias("out"))
    links = edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst",
                                                    (F.col("links") / F.col("out") * DAMPING).alias("share"), F.lit(0.0).alias("own"))
    hosts = edges.select("kind", "src").union(edges.select("kind", "dst")).union(seeds.select("kind", "host")).distinct()
    links = store(links.union(hosts.toDF("kind", "host").select("kind", "host", "host", F.lit(0.0), F.lit(1.0))))
    reached, i = -1, 0
    while True:
        for _ in range(STORE_EVERY):
            sent = F.col("fresh") * F.col("share")
            state = state.join(links, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(
                F.sum(sent).alias("fresh"), F.sum(sent + F.col("own") * F.col("mass")).alias("mass"))
        i += STORE_EVERY
        state = store(state)
        left = state.groupBy("kind").agg(F.sum("fresh").alias("fresh"), F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("n")).collect()
        # all later rounds together add at most fresh / (1 - DAMPING)
        settled = all(k["fresh"] <= TOLERANCE * (1 - DAMPING) * k["mass"] for k in left)
        n = sum(k["n"] for k in left)
        if i >= rounds and settled and n == reached:
            break
        reached = n
    whole = state.groupBy("kind").agg(F.sum("mass").alias("whole"))
    return state.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("mass") / F.col("whole")).alias("score"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url",
          html: str = "html", rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(key, host, path, rule, verdict) of every page."""
    host, path = host_and_path(F.col(url).cast("string"))
    parsed = pages.select(F.col(key), host.alias("host"), path.alias("path"), F.col(html).cast("string").alias("html"))
    rule, says = match_rules(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "says": says})
    rows = store(ruled.drop("html"))
    hosts = store(rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("says") == ALLOW, 1)).alias("allowed"),
        F.count(F.when(F.col("says") == BLOCK, 1)).alias("blocked")).where("host <> ''"))
    seeds = hosts.select("host", F.explode(F.array(
        F.struct(F.lit(ALLOW).alias("kind"), F.col("allowed").alias("mass"), (F.col("allowed") * 2 > F.col("n")).alias("is")),
        F.struct(F.lit(BLOCK).alias("kind"), F.col("blocked").alias("mass"), (F.col("blocked") * 2 > F.col("n")).alias("is"))
    )).alias("s")).where("s.is").select("s.kind", "host", "s.mass")
    found = store(host_edges(parsed, "host", "html"))
    edges = found.select(F.lit(ALLOW).alias("kind"), "src", "dst", "links").unionByName(
        found.select(F.lit(BLOCK).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    scores = propagate(edges, seeds, rounds).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == ALLOW, F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == BLOCK, F.col("score")).otherwise(0.0)).alias("distrust"))
    bad = (F.col("distrust") > 0) & (F.col("distrust") > threshold * F.col("trust"))
    verdicts = store(hosts.join(scores, "host", "left").select(
        "host", "n", F.when(bad, BLOCK).otherwise(ALLOW).alias("by_graph")))
    judged = lookup_join(rows, verdicts, "host", "n")
    return judged.select(key, "host", "path", "rule", F.coalesce("says", "by_graph", F.lit(ALLOW)).alias("verdict"))
