"""Profiles, joins and containment over the test lake."""

from pyspark.sql import functions as F

from joinlift.operators import assoc, joins, profile, prune
from joinlift.plans import testlake as lake
from joinlift.plans.registry import query, rnd, rnd_sql as rs, with_tables

CELLS = lake.cells_sql()
COLS = "dataset_id, col"


def _profile_sql(value: str) -> str:
    return with_tables(f"SELECT {COLS}, {value} FROM cells GROUP BY 1, 2", cells=CELLS)


@query("a01_a02_sizes", with_tables(
    "SELECT dataset_id, max(n) AS n_rows, count(*) AS n_numeric_columns, count(*) AS n_columns, "
    "max(n) / count(*) AS row_column_ratio FROM (SELECT dataset_id, col, count(*) AS n FROM cells "
    "GROUP BY 1, 2) GROUP BY 1", cells=CELLS))
def sizes(spark, sf):
    return profile.dataset_sizes(lake.cells(spark, sf))


@query("a03_mean", _profile_sql(f"{rs('avg(v)', 5)} AS mean"))
def mean(spark, sf):
    return profile.moments(lake.cells(spark, sf)).select("dataset_id", "col",
                                                         rnd("mean", 5).alias("mean"))


@query("a04_missing_share", with_tables(
    "SELECT f.col, count(*) AS n_rows, count(*) - count(c.v) AS n_missing, "
    + rs("1 - count(c.v) / count(*)", 9) + " AS missing_share "
    "FROM (SELECT * FROM (SELECT DISTINCT row_key FROM cells WHERE dataset_id = 'customer'), "
    "(SELECT DISTINCT col FROM cells WHERE dataset_id = 'user_events')) f "
    "LEFT JOIN (SELECT * FROM cells WHERE dataset_id = 'user_events') c USING (row_key, col) "
    "GROUP BY 1", cells=lake.cells_sql("customer", "user_events")))
def missing(spark, sf):
    pairs = lake.pairs(spark, "customer").where("candidate_id = 'user_events'")
    joined = joins.augmentation_join(pairs, lake.cells(spark, sf, "customer", "user_events"))
    side = joined.where("side = 'candidate'").withColumn("dataset_id", F.col("candidate_id"))
    return profile.moments(side).select(
        "col", "n_rows", (F.col("n_rows") - F.col("n_values")).alias("n_missing"),
        rnd("missing_share", 9).alias("missing_share"))


@query("a05_outlier_share", with_tables(
    f"SELECT {COLS}, " + rs("count(*) FILTER (abs((v - m) / nullif(s, 0)) > 3) / count(*)", 9)
    + " AS outlier_share FROM cells JOIN (SELECT dataset_id, col, avg(v) AS m, stddev_pop(v) AS s "
    f"FROM cells GROUP BY 1, 2) USING ({COLS}) GROUP BY 1, 2", cells=CELLS))
def outliers(spark, sf):
    return profile.profile(lake.cells(spark, sf)).select(
        "dataset_id", "col", rnd("outlier_share", 9).alias("outlier_share"))


@query("a06_skewness", _profile_sql(f"{rs('skewness(v)', 6)} AS skewness"))
def skew(spark, sf):
    return profile.moments(lake.cells(spark, sf)).select("dataset_id", "col",
                                                         rnd("skewness", 6).alias("skewness"))


@query("a07_kurtosis", _profile_sql(f"{rs('kurtosis(v)', 6)} AS kurtosis"))
def kurt(spark, sf):
    return profile.moments(lake.cells(spark, sf)).select("dataset_id", "col",
                                                         rnd("kurtosis", 6).alias("kurtosis"))


@query("a08_distinct", _profile_sql("count(DISTINCT v) AS n_distinct"))
def distinct(spark, sf):
    return profile.profile(lake.cells(spark, sf)).select("dataset_id", "col", "n_distinct")


_COLUMN_STATS = (
    f"SELECT {COLS}, count(*) AS n, avg(v) AS mean, skewness(v) AS sk, kurtosis(v) AS ku, "
    "count(DISTINCT v) AS d FROM cells GROUP BY 1, 2")
_OUT = (f"SELECT {COLS}, count(*) FILTER (abs((v - m) / nullif(s, 0)) > 3) / count(*) AS o FROM cells "
        f"JOIN (SELECT {COLS}, avg(v) AS m, stddev_pop(v) AS s FROM cells GROUP BY 1, 2) "
        f"USING ({COLS}) GROUP BY 1, 2")
_FEATURES_SQL = (
    "SELECT dataset_id, count(*)::DOUBLE AS num_of_columns, max(n)::DOUBLE AS num_of_rows, "
    "max(n) / count(*) AS row_column_ratio, max(abs(mean)) AS max_mean, "
    "max(abs(o)) AS max_outlier_percentage, max(abs(sk)) AS max_skewness, "
    "max(abs(ku)) AS max_kurtosis, max(d)::DOUBLE AS max_unique FROM "
    f"({_COLUMN_STATS}) JOIN ({_OUT}) USING ({COLS}) GROUP BY 1")
_PLACES = {"max_mean": 5, "max_outlier_percentage": 9, "max_skewness": 6, "max_kurtosis": 6,
           "row_column_ratio": 6, "num_of_columns": 1, "num_of_rows": 1, "max_unique": 1}


@query("a09_a10_dataset_features", with_tables(
    "SELECT dataset_id, " + ", ".join(f"{rs(f, d)} AS {f}" for f, d in _PLACES.items())
    + f" FROM ({_FEATURES_SQL})", cells=CELLS))
def features(spark, sf):
    f = profile.dataset_features(profile.profile(lake.cells(spark, sf)))
    return f.select("dataset_id", *[rnd(c, d).alias(c) for c, d in _PLACES.items()])


@query("a13_histogram", with_tables(
    "SELECT dataset_id, col, bin, count(*) AS n, " + rs("count(*) / any_value(t)", 9) + " AS share "
    "FROM (SELECT dataset_id, col, coalesce(least(floor((v - lo) / nullif(hi - lo, 0) * 20) + 1, 20), 1)"
    "::BIGINT AS bin, t FROM cells JOIN (SELECT dataset_id, col, min(v) AS lo, max(v) AS hi, count(*) AS t "
    "FROM cells GROUP BY 1, 2) USING (dataset_id, col)) GROUP BY 1, 2, 3", cells=CELLS))
def hist(spark, sf):
    h = profile.histogram(lake.cells(spark, sf), ["dataset_id", "col"], "v", 20)
    return h.withColumn("share", rnd("share", 9))


_J1 = ("SELECT c.col, q.row_key, c2.v FROM (SELECT DISTINCT row_key FROM cells WHERE dataset_id = '{q}') q "
       "CROSS JOIN (SELECT DISTINCT col FROM cells WHERE dataset_id = '{c}') c LEFT JOIN "
       "(SELECT * FROM cells WHERE dataset_id = '{c}') c2 ON c2.row_key = q.row_key AND c2.col = c.col "
       "UNION ALL SELECT col, row_key, v FROM cells WHERE dataset_id = '{q}'")


@query("j01_left_join", with_tables(
    _J1.format(q="customer", c="user_events"), cells=lake.cells_sql("customer", "user_events")))
def left_join(spark, sf):
    pairs = lake.pairs(spark, "customer").where("candidate_id = 'user_events'")
    j = joins.augmentation_join(pairs, lake.cells(spark, sf, "customer", "user_events"))
    return j.select("col", "row_key", "v")


@query("j02_inner_join", with_tables(
    f"SELECT * FROM ({_J1.format(q='orders', c='order_lines')}) WHERE row_key NOT IN (SELECT row_key FROM "
    f"({_J1.format(q='orders', c='order_lines')}) WHERE v IS NULL)",
    cells=lake.cells_sql("orders", "order_lines")))
def inner_join(spark, sf):
    j = joins.augmentation_join(lake.pairs(spark, "orders"),
                                lake.cells(spark, sf, "orders", "order_lines"), how="inner")
    return j.select("col", "row_key", "v")


_DAYS = ("order_days", "ship_days", "event_days")
_J3 = (
    "SELECT k.candidate_id, k.row_key, k.col, " + rs("coalesce(c.v, k.m, 0)", 5) + " AS v FROM "
    "(SELECT a.candidate_id, a.col, b.row_key, m FROM (SELECT dataset_id AS candidate_id, col, "
    "avg(v) FILTER (row_key IN (SELECT row_key FROM cells WHERE dataset_id = 'order_days')) AS m "
    "FROM cells GROUP BY 1, 2) a CROSS JOIN (SELECT DISTINCT row_key FROM cells WHERE "
    "dataset_id = 'order_days') b) k LEFT JOIN cells c ON c.dataset_id = k.candidate_id "
    "AND c.row_key = k.row_key AND c.col = k.col")


@query("j03_many_candidate_join", with_tables(_J3, cells=lake.cells_sql(*_DAYS)))
def many_join(spark, sf):
    cells = lake.cells(spark, sf, *_DAYS)
    candidates = lake.pairs(spark, "order_days").select("candidate_id")
    return joins.many_candidate_join("order_days", candidates, cells).withColumn("v", rnd("v", 5))


@query("j03_wide_table", with_tables(
    "SELECT row_key, " + ", ".join(
        f"max(v) FILTER (candidate_id = '{d}' AND col = '{c}') AS {d}_{c}"
        for d, c in (("order_days", "n_orders"), ("ship_days", "sum_qty"), ("event_days", "n_events")))
    + f" FROM ({_J3}) GROUP BY 1", cells=lake.cells_sql(*_DAYS)))
def wide(spark, sf):
    names = ["order_days_n_orders", "ship_days_sum_qty", "event_days_n_events"]
    joined = many_join(spark, sf).withColumn("name", F.concat_ws("_", "candidate_id", "col"))
    return joins.to_wide(joined.where(F.col("name").isin(names)), names)


_J8 = (
    "SELECT p.query_id, p.candidate_id, nq AS n_query_keys, nc AS n_candidate_keys, coalesce(n, 0) AS n_common "
    "FROM pairs p JOIN (SELECT dataset_id AS query_id, count(DISTINCT row_key) AS nq FROM cells GROUP BY 1) "
    "USING (query_id) JOIN (SELECT dataset_id AS candidate_id, count(DISTINCT row_key) AS nc FROM cells GROUP BY 1) "
    "USING (candidate_id) LEFT JOIN (SELECT a.dataset_id AS query_id, b.dataset_id AS candidate_id, count(*) AS n "
    "FROM keys a JOIN keys b USING (row_key) GROUP BY 1, 2) USING (query_id, candidate_id)")
_J8_CTES = {"cells": CELLS, "pairs": lake.pairs_sql(),
            "keys": "SELECT DISTINCT dataset_id, row_key FROM cells"}


@query("j08_containment", with_tables(
    "SELECT *, " + rs("n_common / n_query_keys", 9) + f" AS containment FROM ({_J8})", **_J8_CTES))
def containment(spark, sf):
    c = joins.containment(lake.pairs(spark), lake.stored_cells(spark, sf))
    return c.withColumn("containment", rnd("containment", 9))


@query("j08_containment_of_joined", with_tables(
    "SELECT query_id, candidate_id, " + rs("n_common / n_query_keys", 9)
    + f" AS containment FROM ({_J8})", **_J8_CTES))
def containment_joined(spark, sf):
    joined = joins.augmentation_join(lake.pairs(spark), lake.stored_cells(spark, sf))
    return joins.containment_of_joined(joined).withColumn("containment", rnd("containment", 9))


@query("j09_discover", with_tables(
    "SELECT query_id, candidate_id, n_query_keys, n_candidate_keys, n_common, "
    + rs("n_common / n_query_keys", 9) + " AS containment FROM ("
    "SELECT a.dataset_id AS query_id, b.dataset_id AS candidate_id, any_value(nq) AS n_query_keys, "
    "any_value(nc) AS n_candidate_keys, count(*) AS n_common FROM keys a JOIN keys b USING (row_key) "
    "JOIN (SELECT dataset_id, count(*) AS nq FROM keys GROUP BY 1) qa ON qa.dataset_id = a.dataset_id "
    "JOIN (SELECT dataset_id, count(*) AS nc FROM keys GROUP BY 1) qb ON qb.dataset_id = b.dataset_id "
    "WHERE a.dataset_id IN ('customer', 'orders', 'order_days') AND a.dataset_id <> b.dataset_id GROUP BY 1, 2) "
    "WHERE n_common >= 0.3 * n_query_keys", **{k: v for k, v in _J8_CTES.items() if k != "pairs"}))
def discover(spark, sf):
    c = joins.discover(lake.queries_frame(spark), lake.cells(spark, sf), 0.3)
    return c.withColumn("containment", rnd("containment", 9))


@query("j10_key_gate", with_tables(
    "SELECT dataset_id, count(*) = count(DISTINCT col || '|' || row_key) AS key_is_unique FROM cells GROUP BY 1",
    cells=CELLS))
def gate(spark, sf):
    return joins.key_gate(lake.cells(spark, sf))


@query("j11_overlap", with_tables(
    "SELECT query_id, candidate_id, n_query_keys, n_candidate_keys, n_common, "
    + rs("n_common / n_query_keys", 9) + " AS containment, "
    + rs("n_common / n_candidate_keys", 9) + " AS candidate_containment, "
    f"n_candidate_keys > n_query_keys AS candidate_is_larger FROM ({_J8})", **_J8_CTES))
def overlap(spark, sf):
    o = joins.overlap(lake.pairs(spark), lake.stored_cells(spark, sf))
    return o.withColumns({c: rnd(c, 9) for c in ("containment", "candidate_containment")})


@query("j13_shared_keys", with_tables(
    "SELECT row_key FROM cells WHERE dataset_id = 'customer' INTERSECT "
    "SELECT row_key FROM cells WHERE dataset_id = 'user_events'",
    cells=lake.cells_sql("customer", "user_events")))
def shared(spark, sf):
    cells = lake.cells(spark, sf, "customer", "user_events")
    return joins.shared_keys(cells.where("dataset_id = 'customer'"),
                             cells.where("dataset_id = 'user_events'"), "row_key")


@query("p03_single_column_candidates", with_tables(
    "SELECT query_id, candidate_id || '/' || c.col AS candidate_id, count(c.v) AS n_joined FROM pairs "
    "JOIN (SELECT DISTINCT dataset_id, row_key FROM cells) q ON q.dataset_id = query_id "
    "JOIN cells c ON c.dataset_id = candidate_id AND c.row_key = q.row_key GROUP BY 1, 2 "
    "HAVING count(c.v) > 0", cells=CELLS, pairs=lake.pairs_sql()))
def single_columns(spark, sf):
    return joins.effective_single_columns(lake.pairs(spark), lake.cells(spark, sf))


_RANKED = (
    f"SELECT query_id, candidate_id, n_common / n_query_keys AS containment FROM ({_J8})")


@query("u01_containment_pruner", with_tables(
    "SELECT query_id, target, candidate_id, " + rs("containment", 9) + " AS containment, rank FROM ("
    "SELECT *, row_number() OVER (PARTITION BY query_id, target ORDER BY containment DESC, candidate_id) AS rank "
    f"FROM ({_RANKED}) JOIN pairs USING (query_id, candidate_id)) WHERE rank <= 1", **_J8_CTES))
def top_containment(spark, sf):
    kept = prune.by_containment(lake.pairs(spark), lake.stored_cells(spark, sf), n=1)
    return kept.select("query_id", "target", "candidate_id",
                       rnd("containment", 9).alias("containment"), "rank")


@query("u02_root_and_threshold_pruner", with_tables(
    "SELECT query_id, target, candidate_id, " + rs("containment", 9) + " AS containment, "
    "rank <= floor(sqrt(n)) AS kept_by_root, containment >= 0.6 AS kept_by_threshold FROM ("
    "SELECT *, row_number() OVER (PARTITION BY query_id, target ORDER BY containment DESC, candidate_id) AS rank, "
    "count(*) OVER (PARTITION BY query_id, target) AS n "
    f"FROM ({_RANKED}) JOIN pairs USING (query_id, candidate_id))", **_J8_CTES))
def root_containment(spark, sf):
    pairs, cells = lake.pairs(spark), lake.stored_cells(spark, sf)
    ranked = prune.ranked_by_containment(pairs, cells)
    root = prune.keep_root(ranked).select("query_id", "target", "candidate_id",
                                          F.lit(True).alias("kept_by_root"))
    return ranked.join(root, ["query_id", "target", "candidate_id"], "left").select(
        "query_id", "target", "candidate_id", rnd("containment", 9).alias("containment"),
        F.coalesce("kept_by_root", F.lit(False)).alias("kept_by_root"),
        (F.col("containment") >= 0.6).alias("kept_by_threshold"))


_MATCHED = (
    "SELECT p.query_id, p.target, p.candidate_id, c.col, q.row_key, c.v AS x, q.v AS y FROM pairs p "
    "JOIN cells q ON q.dataset_id = p.query_id AND q.col = p.target "
    "JOIN cells c ON c.dataset_id = p.candidate_id AND c.row_key = q.row_key")
FLAGSHIP_SQL = with_tables(
    "SELECT query_id, target, candidate_id, " + rs("containment", 9) + " AS containment, "
    + rs("coalesce(p, 0)", 6) + " AS max_pearson, "
    "row_number() OVER (PARTITION BY query_id, target ORDER BY containment DESC, "
    + rs("coalesce(p, 0)", 6) + " DESC, candidate_id) AS rank "
    f"FROM ({_RANKED}) JOIN pairs USING (query_id, candidate_id) LEFT JOIN "
    "(SELECT query_id, target, candidate_id, max(abs(r)) AS p FROM (SELECT query_id, target, candidate_id, col, "
    f"corr(x, y) AS r FROM ({_MATCHED}) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) "
    "USING (query_id, target, candidate_id)", **_J8_CTES)


@query("flagship_which_candidate_to_join", FLAGSHIP_SQL)
def flagship(spark, sf):
    """Which candidate should I join? Containment first, then the strongest Pearson correlation."""
    pairs, cells = lake.pairs(spark), lake.stored_cells(spark, sf)
    linear = assoc.linear(assoc.aligned(pairs, cells, impute=None))
    strongest = linear.groupBy("query_id", "target", "candidate_id").agg(
        F.max(F.abs("pearson")).alias("max_pearson"))
    both = prune.ranked_by_containment(pairs, cells).join(
        strongest, ["query_id", "target", "candidate_id"], "left")
    scored = both.select("query_id", "target", "candidate_id", "containment",
                         rnd(F.coalesce("max_pearson", F.lit(0.0)), 6).alias("max_pearson"))
    return prune.rank_pairs(scored, ["containment", "max_pearson"]).withColumn(
        "containment", rnd("containment", 9))
