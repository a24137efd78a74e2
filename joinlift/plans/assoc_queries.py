"""Association measures, imputation and scaling over the test lake."""

from pyspark.sql import functions as F

from joinlift.functions import pearson as pearson_of
from joinlift.operators import assoc, impute, instances
from joinlift.plans import testlake as lake
from joinlift.plans.registry import query, rnd, rnd_sql as rs, with_tables
from joinlift.schema import PAIR

PKEY = "query_id, target, candidate_id"
GKEY = PKEY + ", col"
# every query row takes part; a missing x is the mean of the matched ones
ALIGNED = (
    f"SELECT y.query_id, y.target, y.candidate_id, m.col, y.row_key, y.y, coalesce(c.v, m.m, 0) AS x FROM "
    "(SELECT p.*, q.row_key, q.v AS y FROM pairs p JOIN cells q ON q.dataset_id = p.query_id AND q.col = p.target) y "
    "JOIN (SELECT p.query_id, p.target, p.candidate_id, c.col, avg(c.v) FILTER (q.row_key IS NOT NULL) AS m "
    "FROM pairs p JOIN cells c ON c.dataset_id = p.candidate_id AND NOT (c.dataset_id = p.query_id AND c.col = p.target) "
    "LEFT JOIN cells q ON q.dataset_id = p.query_id AND q.col = p.target AND q.row_key = c.row_key GROUP BY 1, 2, 3, 4) m "
    f"USING ({PKEY}) LEFT JOIN cells c ON c.dataset_id = y.candidate_id AND c.row_key = y.row_key AND c.col = m.col")
TABLES = dict(cells=lake.cells_sql(), pairs=lake.pairs_sql(), rows=ALIGNED)
OWN = dict(cells=lake.cells_sql("customer", "orders", "order_days"),
           pairs=f"SELECT query_id, target, query_id AS candidate_id FROM ({lake.queries_sql()})",
           rows=ALIGNED)

LINEAR = (f"SELECT {GKEY}, coalesce(CASE WHEN isnan(r) THEN 0 ELSE r END, 0) AS pearson, c AS covariance FROM "
          f"(SELECT {GKEY}, corr(x, y) AS r, covar_samp(x, y) AS c FROM rows GROUP BY ALL)")


def _rank(v: str, group: str, frm: str = "rows") -> str:
    return (f"rank() OVER (PARTITION BY {group} ORDER BY {v}) + "
            f"(count(*) OVER (PARTITION BY {group}, {v}) - 1) / 2.0::DOUBLE")


def spearman_sql(group: str, frm: str = "rows") -> str:
    return (f"SELECT {group}, coalesce(CASE WHEN isnan(r) THEN 0 ELSE r END, 0) AS spearman FROM (SELECT {group}, corr(rx, ry) AS r "
            f"FROM (SELECT {group}, {_rank('x', group)} AS rx, {_rank('y', group)} AS ry FROM {frm}) GROUP BY ALL)")


def nmi_sql(group: str, frm: str = "rows", norm: str = "sqrt(hx * hy)") -> str:
    def h(cols):
        return (f"SELECT {group}, -sum(c / n * ln(c / n)) AS h, count(*) AS k FROM (SELECT {group}, count(*) AS c, "
                f"sum(count(*)) OVER (PARTITION BY {group}) AS n FROM {frm} GROUP BY {group}, {cols}) GROUP BY {group}")
    return (f"SELECT {group}, CASE WHEN kx = 1 AND ky = 1 THEN 1.0::DOUBLE WHEN kx = 1 OR ky = 1 OR hx + hy - hxy <= 2.3e-16 "
            f"THEN 0.0::DOUBLE ELSE (hx + hy - hxy) / {norm} END AS mutual_info FROM "
            f"(SELECT {group}, h AS hx, k AS kx FROM ({h('x')})) JOIN (SELECT {group}, h AS hy, k AS ky FROM ({h('y')})) "
            f"USING ({group}) JOIN (SELECT {group}, h AS hxy FROM ({h('x, y')})) USING ({group})")


def _rows(spark, sf):
    return assoc.aligned(lake.pairs(spark), lake.stored_cells(spark, sf))


def _matched(spark, sf, ranks=False):
    return assoc.match(lake.pairs(spark), lake.stored_cells(spark, sf), ranks=ranks)


def _own_rows(spark, sf):
    cells = lake.cells(spark, sf, "customer", "orders", "order_days")
    return assoc.aligned(assoc.own_pairs(lake.queries_frame(spark)), cells, impute=None)


@query("c01_pearson", with_tables(
    f"SELECT {GKEY}, {rs('pearson', 6)} AS pearson FROM ({LINEAR})", **TABLES))
def pearson(spark, sf):
    return assoc.matched_linear(_matched(spark, sf)).select(*PAIR, "col", rnd("pearson", 6).alias("pearson"))


@query("c02_max_pearson", with_tables(
    f"SELECT {PKEY}, {rs('max(abs(pearson))', 6)} AS max_pearson FROM ({LINEAR}) GROUP BY ALL", **TABLES))
def max_pearson(spark, sf):
    top = assoc.matched_linear(_matched(spark, sf)).groupBy(*PAIR).agg(F.max(F.abs("pearson")).alias("p"))
    return top.select(*PAIR, rnd("p", 6).alias("max_pearson"))


@query("c03_pearson_difference", with_tables(
    f"SELECT {PKEY}, {rs('c.p - q.p', 6)} AS max_pearson_difference FROM "
    f"(SELECT {PKEY}, max(abs(pearson)) AS p FROM ({LINEAR}) WHERE candidate_id <> query_id GROUP BY ALL) c JOIN "
    f"(SELECT query_id, target, max(abs(pearson)) AS p FROM ({LINEAR}) WHERE candidate_id = query_id GROUP BY ALL) q "
    "USING (query_id, target)",
    cells=lake.cells_sql(),
    pairs=f"{lake.pairs_sql()} UNION ALL SELECT query_id, target, query_id FROM ({lake.queries_sql()})",
    rows=ALIGNED))
def pearson_difference(spark, sf):
    own = assoc.linear(_own_rows(spark, sf)).groupBy("query_id", "target").agg(
        F.max(F.abs("pearson")).alias("q"))
    theirs = assoc.matched_linear(_matched(spark, sf)).groupBy(*PAIR).agg(F.max(F.abs("pearson")).alias("c"))
    return theirs.join(own, ["query_id", "target"]).select(*PAIR, rnd(
        assoc.pearson_difference(F.col("c"), F.col("q")), 6).alias("max_pearson_difference"))


@query("c04_spearman", with_tables(
    f"SELECT {GKEY}, {rs('spearman', 6)} AS spearman FROM ({spearman_sql(GKEY)})", **TABLES))
def spearman(spark, sf):
    return assoc.matched_spearman(_matched(spark, sf, ranks=True)).select(*PAIR, "col", rnd("spearman", 6).alias("spearman"))


# inversions by definition, 0 where a side is constant; DuckDB compares all row pairs of a base, which the rows of "orders" are too many for
_KENDALL_LAKE = ("customer", "cust_orders", "user_events", "order_days", "ship_days", "event_days")
_DAY = dict(cells=lake.cells_sql(*_KENDALL_LAKE), pairs=lake.pairs_sql("customer", "order_days"), rows=ALIGNED)
KENDALL = (
    "SELECT {g}, coalesce(sum(sign(a.x - b.x) * sign(a.y - b.y)) / nullif(sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))), 0), 0) AS kendall "
    "FROM (SELECT *, row_number() OVER () AS i FROM rows) a JOIN (SELECT *, row_number() OVER () AS i FROM rows) b "
    "USING ({g}) WHERE a.i <> b.i GROUP BY ALL")


@query("c05_kendall", with_tables(
    f"SELECT {GKEY}, {rs('kendall', 6)} AS kendall FROM ({KENDALL.format(g=GKEY)})", **_DAY))
def kendall(spark, sf):
    rows = assoc.aligned(lake.pairs(spark, "customer", "order_days"), lake.stored_cells(spark, sf, *_KENDALL_LAKE))
    k = assoc.kendall(assoc.joint_counts(rows))
    return k.select(*PAIR, "col", rnd("kendall", 6).alias("kendall"))


@query("c06_covariance", with_tables(
    f"SELECT {GKEY}, {rs('covariance', 2)} AS covariance FROM ({LINEAR})", **TABLES))
def covariance(spark, sf):
    return assoc.matched_linear(_matched(spark, sf)).select(*PAIR, "col", rnd("covariance", 2).alias("covariance"))


@query("c07_mutual_information", with_tables(
    f"SELECT {GKEY}, {rs('mutual_info', 6)} AS mutual_info FROM ({nmi_sql(GKEY)})", **TABLES))
def mutual_info(spark, sf):
    m = assoc.matched_information(_matched(spark, sf, ranks=True))
    return m.select(*PAIR, "col", rnd("mutual_info", 6).alias("mutual_info"))


@query("c07_mutual_information_arithmetic", with_tables(
    f"SELECT {GKEY}, {rs('mutual_info', 6)} AS mutual_info FROM ({nmi_sql(GKEY, norm='((hx + hy) / 2)')})", **OWN))
def mutual_info_arithmetic(spark, sf):
    m = assoc.normalised_mutual_information(assoc.joint_counts(_own_rows(spark, sf)),
                                            norm="arithmetic")
    return m.select(*PAIR, "col", rnd("mutual_info", 6).alias("mutual_info"))


def strongest_sql(prefix: str) -> str:
    return (f"SELECT {PKEY}, max(abs(pearson)) AS {prefix}max_pearson, max(abs(spearman)) AS {prefix}max_spearman, "
            f"max(abs(covariance)) AS {prefix}max_covariance, max(abs(mutual_info)) AS {prefix}max_mutual_info FROM "
            f"({LINEAR}) JOIN ({spearman_sql(GKEY)}) USING ({GKEY}) JOIN ({nmi_sql(GKEY)}) USING ({GKEY}) GROUP BY ALL")


_FOUR = {"max_pearson": 6, "max_spearman": 6, "max_covariance": 2, "max_mutual_info": 6}


@query("c08_target_features", with_tables(
    f"SELECT {PKEY}, " + ", ".join(f"{rs(c, d)} AS {c}" for c, d in _FOUR.items())
    + f" FROM ({strongest_sql('')})", **TABLES))
def target_features(spark, sf):
    f = assoc.strongest(assoc.matched_measures(_matched(spark, sf, ranks=True)))
    return f.select(*PAIR, *[rnd(c, d).alias(c) for c, d in _FOUR.items()])


_WITHIN = dict(
    cells=lake.cells_sql("customer", "order_days", "user_events"),
    rows="SELECT a.dataset_id, a.col AS col_a, b.col AS col_b, a.v AS x, b.v AS y FROM cells a "
         "JOIN cells b ON a.dataset_id = b.dataset_id AND a.row_key = b.row_key AND a.col < b.col")
_WKEY = "dataset_id, col_a, col_b"


@query("c09_within_dataset", with_tables(
    f"SELECT {_WKEY}, {rs('pearson', 6)} AS pearson, {rs('covariance', 3)} AS covariance, "
    f"{rs('spearman', 6)} AS spearman, {rs('mutual_info', 6)} AS mutual_info, {rs('kendall', 6)} AS kendall FROM "
    f"(SELECT {_WKEY}, corr(x, y) AS pearson, covar_samp(x, y) AS covariance FROM rows GROUP BY ALL) "
    f"JOIN ({spearman_sql(_WKEY)}) USING ({_WKEY}) JOIN ({nmi_sql(_WKEY)}) USING ({_WKEY}) "
    f"JOIN ({KENDALL.format(g=_WKEY)}) USING ({_WKEY})", **_WITHIN))
def within(spark, sf):
    rows = assoc.within_dataset(lake.cells(spark, sf, "customer", "order_days", "user_events"))
    m = assoc.measures(rows, ["dataset_id", "col_a", "col_b"], with_kendall=True)
    return m.select("dataset_id", "col_a", "col_b", *[rnd(c, 3 if c == "covariance" else 6).alias(c)
                    for c in ("pearson", "covariance", "spearman", "mutual_info", "kendall")])


_VECTOR = {**{f"{s}_{f}": d for s in ("query", "candidate") for f, d in {
    "num_of_columns": 1, "num_of_rows": 1, "row_column_ratio": 6, "max_mean": 5,
    "max_outlier_percentage": 9, "max_skewness": 6, "max_kurtosis": 6, "max_unique": 1}.items()},
    **{f"{s}_target_{f}": d for s in ("query", "candidate") for f, d in _FOUR.items()},
    "max_pearson_difference": 6, "containment_fraction": 9}
_VECTOR["candidate_num_rows"] = _VECTOR.pop("candidate_num_of_rows")


def _profile_side(side: str) -> str:
    from joinlift.plans.lake_queries import _FEATURES_SQL
    from joinlift.schema import CANDIDATE_FEATURES, PROFILE_FEATURES, QUERY_FEATURES
    names = QUERY_FEATURES if side == "query" else CANDIDATE_FEATURES
    renamed = ", ".join(f"{a} AS {b}" for a, b in zip(PROFILE_FEATURES, names))
    return f"SELECT dataset_id AS {side}_id, {renamed} FROM ({_FEATURES_SQL})"


def _pair_part() -> str:
    from joinlift.plans.lake_queries import _J8
    return (f"SELECT {PKEY}, query_target_max_pearson, query_target_max_spearman, query_target_max_covariance, "
            "query_target_max_mutual_info, candidate_target_max_pearson, candidate_target_max_spearman, "
            "candidate_target_max_covariance, candidate_target_max_mutual_info, "
            "candidate_target_max_pearson - query_target_max_pearson AS max_pearson_difference, "
            "n_common / n_query_keys AS containment_fraction FROM "
            f"(SELECT * FROM ({strongest_sql('candidate_target_')}) WHERE candidate_id <> query_id) "
            f"JOIN (SELECT * EXCLUDE (candidate_id) FROM ({strongest_sql('query_target_')}) WHERE candidate_id = query_id) "
            f"USING (query_id, target) JOIN ({_J8}) USING (query_id, candidate_id)")


_BOTH = dict(
    cells=lake.cells_sql(),
    pairs=f"{lake.pairs_sql()} UNION ALL SELECT query_id, target, query_id FROM ({lake.queries_sql()})",
    keys="SELECT DISTINCT dataset_id, row_key FROM cells", rows=ALIGNED)


@query("c10_pair_features", with_tables(
    f"SELECT {PKEY}, " + ", ".join(f"{rs(c, d)} AS {c}" for c, d in list(_VECTOR.items()) if "target" in c
                                   or c in ("max_pearson_difference", "containment_fraction"))
    + f" FROM ({_pair_part()})", **_BOTH))
def pair_features(spark, sf):
    f = instances.pair_features(lake.pairs(spark), lake.stored_cells(spark, sf))
    return f.select(*PAIR, *[rnd(c, d).alias(c) for c, d in _VECTOR.items() if c in f.columns])


@query("c11_feature_vectors", with_tables(
    f"SELECT {PKEY}, " + ", ".join(f"{rs(c, d)} AS {c}" for c, d in _VECTOR.items())
    + f" FROM ({_pair_part()}) JOIN ({_profile_side('query')}) USING (query_id) "
      f"JOIN ({_profile_side('candidate')}) USING (candidate_id)", **_BOTH))
def feature_vectors(spark, sf):
    """Profile, association and containment of every pair: the 26 inputs of the metamodel."""
    f = instances.feature_vectors(lake.pairs(spark), lake.stored_cells(spark, sf))
    return f.select(*PAIR, *[rnd(c, d).alias(c) for c, d in _VECTOR.items()])


@query("a11_profile_once_per_query", with_tables(
    f"SELECT {PKEY}, query_num_of_rows, {rs('query_max_mean', 5)} AS query_max_mean, candidate_num_rows, "
    f"{rs('candidate_max_mean', 5)} AS candidate_max_mean FROM pairs JOIN ({_profile_side('query')}) USING (query_id) "
    f"JOIN ({_profile_side('candidate')}) USING (candidate_id)",
    cells=lake.cells_sql(), pairs=lake.pairs_sql()))
def profile_reuse(spark, sf):
    f = instances.profile_features(lake.pairs(spark), lake.stored_cells(spark, sf))
    return f.select(*PAIR, "query_num_of_rows", rnd("query_max_mean", 5).alias("query_max_mean"),
                    "candidate_num_rows", rnd("candidate_max_mean", 5).alias("candidate_max_mean"))


@query("c12_correlation_with_gain", with_tables(
    f"SELECT {rs('corr(containment, gain)', 8)} AS containment_gain, {rs('corr(p_gain, gain)', 8)} AS p_gain_gain, "
    "count(*) AS n FROM s", s=lake.SCORED_SQL))
def correlation(spark, sf):
    s = lake.scored(spark, sf)
    return s.agg(rnd(pearson_of("containment", "gain"), 8).alias("containment_gain"),
                 rnd(pearson_of("p_gain", "gain"), 8).alias("p_gain_gain"), F.count(F.lit(1)).alias("n"))


# ---- imputation, scaling, clean-up -----------------------------------------------------------

_HOLES = (
    "SELECT k.row_key, c.col, e.v FROM (SELECT DISTINCT row_key FROM cells WHERE dataset_id = 'customer') k "
    "CROSS JOIN (SELECT DISTINCT col FROM cells WHERE dataset_id = 'user_events') c LEFT JOIN cells e "
    "ON e.dataset_id = 'user_events' AND e.row_key = k.row_key AND e.col = c.col")
_HOLE_TABLES = dict(cells=lake.cells_sql("customer", "user_events"), h=_HOLES)


def _holes(spark, sf):
    from joinlift.operators import joins
    pairs = lake.pairs(spark, "customer").where("candidate_id = 'user_events'")
    j = joins.augmentation_join(pairs, lake.cells(spark, sf, "customer", "user_events"))
    return j.where("side = 'candidate'").select("row_key", "col", "v")


def _impute_sql(fill: str) -> str:
    return with_tables(f"SELECT row_key, col, {rs('coalesce(v, f)', 5)} AS v FROM h JOIN (SELECT col, {fill} AS f FROM h "
                       "GROUP BY 1) USING (col)", **_HOLE_TABLES)


def _impute(strategy):
    def run(spark, sf):
        return impute.impute(_holes(spark, sf), ["col"], "v", ["row_key"], strategy).select(
            "row_key", "col", rnd("v", 5).alias("v"))
    return run


query("i01_impute_mean", _impute_sql("avg(v)"))(_impute("mean"))
query("i01_impute_median", _impute_sql("median(v)"))(_impute("median"))
query("i01_impute_most_frequent", with_tables(
    f"SELECT row_key, col, {rs('coalesce(v, f)', 5)} AS v FROM h JOIN (SELECT col, v AS f FROM (SELECT col, v, "
    "row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, v) AS k FROM h WHERE v IS NOT NULL GROUP BY 1, 2) WHERE k = 1) "
    "USING (col)", **_HOLE_TABLES))(_impute("most_frequent"))


@query("i02_infinite_to_mean", with_tables(
    f"SELECT query_id, candidate_id, {rs('coalesce(g, avg(g) OVER (PARTITION BY query_id), 0)', 6)} AS g FROM "
    "(SELECT *, CASE WHEN r2_before = 0 THEN NULL ELSE r2_after / r2_before END AS g FROM t)", t=lake.INSTANCES_SQL))
def infinite(spark, sf):
    inst = lake.instances(spark, sf).withColumn("g", F.when(
        F.col("r2_before") == 0, F.lit(float("inf"))).otherwise(F.col("r2_after") / F.nullif(
            F.col("r2_before"), F.lit(0.0))))
    out = impute.impute(inst, ["query_id"], "g", ["candidate_id"])
    return out.select("query_id", "candidate_id", rnd("g", 6).alias("g"))


@query("i03_standardise", with_tables(
    f"SELECT dataset_id, row_key, col, {rs('coalesce((v - m) / nullif(s, 0), 0)', 5)} AS v FROM cells JOIN (SELECT dataset_id, "
    "col, avg(v) AS m, stddev_pop(v) AS s FROM cells GROUP BY 1, 2) USING (dataset_id, col)",
    cells=lake.cells_sql("order_days", "ship_days")))
def standardise(spark, sf):
    out = impute.standardise(lake.cells(spark, sf, "order_days", "ship_days"),
                             ["dataset_id", "col"], ["v"], ["row_key"])
    return out.select("dataset_id", "row_key", "col", rnd("v", 5).alias("v"))


@query("i04_min_max", with_tables(
    f"SELECT query_id, candidate_id, {rs('(containment - a) / (b - a)', 9)} AS containment, "
    f"{rs('(price - c) / (d - c)', 9)} AS price FROM s, (SELECT min(containment) AS a, max(containment) AS b, "
    "min(price) AS c, max(price) AS d FROM s)", s=lake.SCORED_SQL))
def min_max(spark, sf):
    out = impute.min_max(lake.scored(spark, sf), [], ["containment", "price"], [])
    return out.select("query_id", "candidate_id", rnd("containment", 9).alias("containment"),
                      rnd("price", 9).alias("price"))


@query("i05_divide_by_max", with_tables(
    f"SELECT query_id, candidate_id, {rs('pearson_difference / m', 9)} AS pearson_difference FROM s JOIN "
    "(SELECT query_id, max(abs(pearson_difference)) AS m FROM s GROUP BY 1) USING (query_id)", s=lake.SCORED_SQL))
def divide(spark, sf):
    out = impute.divide_by_max(lake.scored(spark, sf), ["query_id"], "pearson_difference",
                               ["candidate_id"], absolute=True)
    return out.select("query_id", "candidate_id",
                      rnd("pearson_difference", 9).alias("pearson_difference"))


@query("i06_z_outliers", with_tables(
    "SELECT query_id, candidate_id, gain FROM s, (SELECT avg(gain) AS m, stddev_pop(gain) AS d, avg(price) AS m2, "
    "stddev_pop(price) AS d2 FROM s) WHERE abs((gain - m) / d) <= 3 AND abs((price - m2) / d2) <= 3", s=lake.SCORED_SQL))
def z_outliers(spark, sf):
    return impute.drop_z_outliers(lake.scored(spark, sf), ["gain", "price"]).select(
        "query_id", "candidate_id", "gain")


@query("i07_mad_outliers", with_tables(
    "SELECT query_id, candidate_id, gain FROM s, (SELECT median(gain) AS m FROM s), "
    "(SELECT median(abs(gain - m)) * 1.4826 AS d FROM s, (SELECT median(gain) AS m FROM s)) WHERE abs(gain - m) / d < 2",
    s=lake.SCORED_SQL))
def mad_outliers(spark, sf):
    return impute.drop_mad_outliers(lake.scored(spark, sf), "gain").select(
        "query_id", "candidate_id", "gain")


@query("i07_mean_deviation_outliers", with_tables(
    "SELECT query_id, candidate_id, gain FROM s, (SELECT median(gain) AS m FROM s), "
    "(SELECT avg(abs(gain - m)) AS d FROM s, (SELECT avg(gain) AS m FROM s)) WHERE abs(gain - m) / d < 3",
    s=lake.SCORED_SQL))
def mean_dev_outliers(spark, sf):
    return impute.drop_mad_outliers(lake.scored(spark, sf), "gain", kind="mean").select(
        "query_id", "candidate_id", "gain")


@query("i08_small_and_large", with_tables(
    "SELECT query_id, candidate_id, gain, CASE WHEN abs(gain) <= 0.1 THEN 'small' ELSE 'large' END AS size FROM s "
    "WHERE abs(gain) <= 0.1 OR abs(gain) > 1", s=lake.SCORED_SQL))
def small_and_large(spark, sf):
    s = lake.scored(spark, sf).select("query_id", "candidate_id", "gain")
    return impute.keep_small(s, "gain", 0.1).withColumn("size", F.lit("small")).unionByName(
        impute.keep_large(s, "gain", 1.0).withColumn("size", F.lit("large")))
