"""Splits, labels, rankings and reports over the table of scored pairs."""

from pyspark.sql import functions as F

from joinlift.functions import hash_order
from joinlift.operators import joins, labels, profile, prune, rank, report, scores, splits
from joinlift.plans import testlake as lake
from joinlift.plans.registry import hash_sql, md5_sql, query, rnd, rnd_sql as rs, with_tables
from joinlift.schema import PAIR

S = dict(s=lake.SCORED_SQL)
ID = "query_id, candidate_id"
PKEY = "query_id, target, candidate_id"
Q = "query_id, target"


# ---- splits and filters ----------------------------------------------------------------------

def _columns(spark, sf):
    src = lake.sources(spark, sf).select("dataset_id", "col").distinct()
    return src.withColumn("is_target", F.col("col").isin(list(lake.SOURCE_TARGETS.values())))


_SRC = dict(src=lake.sources_sql())
# with at most 3 free columns: every k-subset size as often as there are subsets, md5 order decides
_SPLITS = (
    "slots AS (SELECT dataset_id, n, k, copy, row_number() OVER (PARTITION BY dataset_id ORDER BY "
    + hash_sql("splits", "dataset_id", "k", "copy") + ", k, copy) AS split_no FROM (SELECT dataset_id, count(*) AS n FROM cols "
    "WHERE NOT is_target GROUP BY 1) JOIN (VALUES (3, 1, 1), (3, 1, 2), (3, 1, 3), (3, 2, 1), (3, 2, 2), (3, 2, 3), (2, 1, 1), (2, 1, 2)) "
    "t(n, k, copy) USING (n)), "
    "placed AS (SELECT dataset_id, split_no, col, n, k, row_number() OVER (PARTITION BY dataset_id, split_no ORDER BY "
    + hash_sql("splits", "dataset_id", "split_no", "col") + ", col) AS rn FROM slots JOIN cols USING (dataset_id) "
    "WHERE NOT is_target AND split_no <= 5), "
    "sides AS (SELECT dataset_id, split_no, col, CASE WHEN rn <= k THEN 'query' ELSE 'candidate' END AS side FROM placed), "
    "firsts AS (SELECT dataset_id, min(split_no) AS split_no FROM (SELECT dataset_id, split_no, "
    "string_agg(col, ',' ORDER BY col) AS qs FROM sides WHERE side = 'query' GROUP BY 1, 2) GROUP BY dataset_id, qs), "
    "splits AS (SELECT sides.* FROM sides JOIN firsts USING (dataset_id, split_no) UNION ALL "
    "SELECT dataset_id, split_no, col, 'query' FROM cols JOIN firsts USING (dataset_id) WHERE is_target) ")
_COLS = ("SELECT DISTINCT dataset_id, col, col IN ('l_extendedprice', 'p_retailprice', 'c_acctbal', 's_acctbal') "
         "AS is_target FROM src")


def _splits_sql(body):
    return f"WITH src AS ({lake.sources_sql()}), cols AS ({_COLS}), {_SPLITS} {body}"


@query("p01_make_splits", _splits_sql("SELECT dataset_id, split_no::INTEGER AS split_no, col, side FROM splits"))
def make_splits(spark, sf):
    return splits.make_splits(_columns(spark, sf), max_splits=5, max_columns=30)


@query("p02_project_splits", _splits_sql(
    "SELECT dataset_id || '#' || split_no || side[1:1] AS dataset_id, side, col, count(*) AS n, "
    + rs("sum(coalesce(v, 0))", 2) + " AS total FROM splits JOIN src USING (dataset_id, col) GROUP BY ALL"))
def project(spark, sf):
    made = splits.make_splits(_columns(spark, sf), max_splits=5, max_columns=30)
    cut = splits.project_split(made, lake.sources(spark, sf))
    return cut.groupBy("dataset_id", "side", "col").agg(F.count(F.lit(1)).alias("n"),
                                                        rnd(F.sum("v"), 2).alias("total"))


@query("p04_split_by_source", with_tables(
    f"SELECT {ID}, CASE WHEN {hash_sql('source-split', 'query_id')} % 10 < 7 THEN 'train' ELSE 'test' END AS part FROM s", **S))
def by_source(spark, sf):
    return splits.split_by_hash(lake.scored(spark, sf), ["query_id"]).select(
        "query_id", "candidate_id", "part")


@query("p05_split_by_groups", with_tables(
    f"SELECT {ID}, CASE WHEN k < floor(n * 0.6::DOUBLE) THEN 'train' WHEN k < floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) "
    "THEN 'valid' ELSE 'test' END AS part FROM s JOIN (SELECT query_id[10:] AS base, target, row_number() OVER (ORDER BY "
    + md5_sql("group-split", "query_id[10:]", "target") + ", query_id[10:], target) - 1 AS k, count(*) OVER () AS n "
    f"FROM (SELECT DISTINCT {Q} FROM s)) g ON g.base = s.query_id[10:] AND g.target = s.target", **S))
def by_groups(spark, sf):
    rows = lake.scored(spark, sf).withColumn("base", splits.base_name("query_id"))
    return splits.split_by_groups(rows, ["base", "target"], 0.6, 0.2).select(
        "query_id", "candidate_id", "part")


@query("p06_by_key_lists", with_tables(
    f"SELECT {ID}, gain FROM s WHERE query_id IN (SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_acctbal < 5000) "
    "AND candidate_id IN ('part/1', 'part/2', 'part/3', 'part/5', 'part/8', 'part/13')", **S))
def key_lists(spark, sf):
    lines = lake.table(spark, sf, "supplier").where("s_acctbal < 5000").select(F.concat(
        F.lit("l_extendedprice,supplier/"), F.col("s_suppkey").cast("string"),
        F.lit(",part/1,part/2,part/3,part/5,part/8,part/13")).alias("line"))
    return splits.by_key_lists(lake.scored(spark, sf), lines).select("query_id", "candidate_id", "gain")


@query("p07_folds", with_tables(
    f"SELECT {ID}, ({hash_sql('42', 'query_id', 'candidate_id')} % 10)::INTEGER AS fold FROM s", **S))
def folds(spark, sf):
    return splits.folds(lake.scored(spark, sf), ["query_id", "candidate_id"], 10).select(
        "query_id", "candidate_id", "fold")


@query("p08_hold_out", f"SELECT c_custkey::VARCHAR AS row_key, {hash_sql('42', 'c_custkey')} % 100 < 67 AS is_train FROM customer")
def hold_out(spark, sf):
    keys = lake.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("row_key"))
    return splits.hold_out(keys)


@query("p09_balance_classes", with_tables(
    f"SELECT {ID}, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {md5_sql('balance', 'query_id', 'candidate_id')}, "
    f"{ID}) AS k FROM s) WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM s GROUP BY class))", **S))
def balance(spark, sf):
    return splits.balance_classes(lake.scored(spark, sf), "class", ["query_id", "candidate_id"]).select(
        "query_id", "candidate_id", "class")


def _draw_sql(group):
    return with_tables(
        f"SELECT {ID}, gain_marker FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY "
        f"{hash_sql('draw', 'query_id', 'target', 'candidate_id')}, target, candidate_id) AS k FROM s WHERE query_id IN "
        f"(SELECT query_id FROM (SELECT DISTINCT query_id FROM s) ORDER BY {md5_sql('draw', 'query_id')} LIMIT 50)) WHERE k = 1", **S)


@query("p10_draw_one_per_query", _draw_sql("query_id"))
def draw_one(spark, sf):
    return splits.draw_per_query(lake.scored(spark, sf), 50).select("query_id", "candidate_id", "gain_marker")


@query("p10_draw_two_per_query", _draw_sql("query_id, gain_marker"))
def draw_two(spark, sf):
    return splits.draw_per_query(lake.scored(spark, sf), 50, "gain_marker").select(
        "query_id", "candidate_id", "gain_marker")


THETAS = [i / 20 for i in range(21)]
_LADDER = "(SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in THETAS) + "]) AS theta)"


@query("p11_a15_theta_ladder", with_tables(
    "SELECT theta, count(*) AS n, count(*) FILTER (class = 'gain') AS n_positive, count(*) FILTER (class <> 'gain') AS n_negative, "
    f"{rs('count(*) FILTER (class = ' + chr(39) + 'gain' + chr(39) + ') / count(*)', 9)} AS success_share "
    f"FROM s JOIN {_LADDER} ON containment >= theta GROUP BY 1", **S))
def ladder(spark, sf):
    out = profile.class_balance(lake.scored(spark, sf), THETAS, "containment", "class")
    return out.withColumn("success_share", rnd("success_share", 9))


@query("p11_containment_filter", with_tables(f"SELECT {ID}, containment FROM s WHERE containment >= 0.7", **S))
def theta_filter(spark, sf):
    return splits.at_least(lake.scored(spark, sf), "containment", 0.7).select(
        "query_id", "candidate_id", "containment")


@query("p12_uncertainty_filter", with_tables(f"SELECT {ID}, p_gain FROM s WHERE NOT p_gain BETWEEN 0.4 AND 0.6", **S))
def uncertain(spark, sf):
    return splits.drop_uncertain(lake.scored(spark, sf), "p_gain").select(
        "query_id", "candidate_id", "p_gain")


@query("p13_gain_bands", with_tables(
    f"SELECT {ID}, gain, 'clear' AS band FROM s WHERE gain > 0.025 OR gain < 0 UNION ALL SELECT {ID}, gain, 'large' FROM s WHERE "
    f"abs(gain) > 0.05 UNION ALL SELECT {ID}, gain, 'small' FROM s WHERE abs(gain) <= 0.05 UNION ALL "
    f"SELECT {ID}, gain, 'unit' FROM s WHERE gain BETWEEN -1 AND 1", **S))
def bands(spark, sf):
    s = lake.scored(spark, sf).select("query_id", "candidate_id", "gain")
    out = None
    for kind in ("clear", "large", "small", "unit"):
        one = splits.gain_band(s, "gain", kind).withColumn("band", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("p14_scoreable_rows", with_tables(
    f"SELECT {ID}, coalesce(gain, 0) AS gain, price FROM t WHERE abs(coalesce(gain, 0)) < 3.4028235e38", t=lake.INSTANCES_SQL))
def scoreable(spark, sf):
    return splits.scoreable(lake.instances(spark, sf), ["gain", "price"]).select(
        "query_id", "candidate_id", "gain", "price")


@query("p15_first_of_each",
       "SELECT l_suppkey, l_partkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey "
       "ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1")
def first_of_each(spark, sf):
    li = lake.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber",
                                                  "l_quantity", "l_extendedprice")
    return splits.first_of_each(li, ["l_suppkey", "l_partkey"], [
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]).select(
        "l_suppkey", "l_partkey", "l_orderkey", "l_quantity")


@query("p16_u09_random_share", with_tables(
    f"SELECT {PKEY} FROM (SELECT *, row_number() OVER (PARTITION BY {Q} ORDER BY {md5_sql('random', 'query_id', 'target', 'candidate_id')}) AS k, "
    f"count(*) OVER (PARTITION BY {Q}) AS n FROM s) WHERE k - 1 < floor(n * (1.0::DOUBLE - 0.8::DOUBLE))", **S))
def random_share(spark, sf):
    return prune.at_random(lake.scored(spark, sf), 0.8)


_ANGLE = "2 * 3.141592653589793::DOUBLE / {p}"
_CYCLE = {"month": ("month(ts) - 1", 24), "day": ("day(ts) - 1", 12), "hour": ("hour(ts) - 1", 12),
          "weekday": ("isodow(ts) - 1", 7)}


@query("p17_cyclic_time", "SELECT event_id, " + ", ".join(
    f"{rs(f'{fn}(({e}) * ({_ANGLE.format(p=p)}))', 9)} AS {n}_{fn}" for n, (e, p) in _CYCLE.items() for fn in ("sin", "cos"))
    + " FROM events")
def cyclic(spark, sf):
    out = splits.cyclic_time(lake.table(spark, sf, "events").select("event_id", "ts"), "ts")
    return out.select("event_id", *[rnd(f"{n}_{fn}", 9).alias(f"{n}_{fn}") for n in _CYCLE for fn in ("sin", "cos")])


@query("p18_clean_names", "SELECT url, regexp_replace(url, '[\\[\\]<]', '_', 'g') AS clean, raw, regexp_replace(raw, '[\\[\\]<]', '_', 'g') AS name "
       "FROM pages FULL JOIN (SELECT p_partkey, p_name || '[' || p_brand || ']<' AS raw FROM part) ON p_partkey = page_id")
def clean_names(spark, sf):
    """Each page with the part of its number, and every page and part that has none beside it."""
    pages = lake.table(spark, sf, "pages").select("page_id", "url")
    part = lake.table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit("["), "p_brand", F.lit("]<")).alias("raw"))
    return pages.join(part, F.col("p_partkey") == F.col("page_id"), "full").select(
        "url", splits.clean_name("url").alias("clean"), "raw", splits.clean_name("raw").alias("name"))


# ---- negative pairs --------------------------------------------------------------------------

def _many_datasets(spark, sf):
    """Each part as a dataset: its brand is the source, its size gives the column counts."""
    return lake.table(spark, sf, "part").select(
        F.col("p_brand").alias("source"),
        F.concat(F.lit("q/"), F.col("p_partkey").cast("string")).alias("query_id"),
        F.concat(F.lit("c/"), F.col("p_partkey").cast("string")).alias("candidate_id"),
        (F.col("p_size") % 7 + 1).alias("n_query_cols"),
        (F.col("p_size") % 5 + 1).alias("n_candidate_cols"))


_NEG = (
    "SELECT query_id, candidate_id, source, c_source, available FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
    "ORDER BY w, h, candidate_id) - 1 AS nth, count(*) OVER (PARTITION BY query_id) AS available FROM "
    "(SELECT q.query_id, q.source, c.candidate_id, c.source AS c_source, c.w, c.h FROM d q JOIN (SELECT candidate_id, source, "
    "n_candidate_cols AS w, md5(source) AS h FROM d) c ON q.source <> c.source AND q.n_query_cols + c.w <= 8)) "
    "WHERE list_contains(list_transform(range(least(20, available)), lambda i: ("
    + hash_sql("negatives", "query_id") + " % available + (i * available) // least(20, available)) % available), nth)")


@query("j06_negative_pairs", with_tables(_NEG, d=(
    "SELECT p_brand AS source, 'q/' || p_partkey AS query_id, 'c/' || p_partkey AS candidate_id, p_size % 7 + 1 AS n_query_cols, "
    "p_size % 5 + 1 AS n_candidate_cols FROM part")))
def negative_pairs(spark, sf):
    return joins.negative_pairs(_many_datasets(spark, sf), max_columns=8, per_query=20)


_POS = "SELECT dataset_id, row_key, row_number() OVER (PARTITION BY dataset_id ORDER BY min(row_ord), row_key) - 1 AS pos FROM src GROUP BY 1, 2"


@query("j07_positional_rekey", with_tables(
    "SELECT p.query_id, p.candidate_id, p.candidate_id || '@' || p.query_id AS dataset_id, coalesce(q.row_key, 'x-' || c.pos) AS row_key, "
    "s.col, s.v FROM pairs p JOIN pos c ON c.dataset_id = p.candidate_id LEFT JOIN pos q ON q.dataset_id = p.query_id AND q.pos = c.pos "
    "JOIN src s ON s.dataset_id = p.candidate_id AND s.row_key = c.row_key",
    src=lake.sources_sql(), pos=_POS,
    pairs="SELECT * FROM (VALUES ('customer', 'part'), ('part', 'customer'), ('supplier', 'lineitem')) t(query_id, candidate_id)"))
def rekey(spark, sf):
    pairs = spark.createDataFrame([("customer", "part"), ("part", "customer"), ("supplier", "lineitem")],
                                  "query_id string, candidate_id string")
    return joins.positional_rekey(pairs, lake.sources(spark, sf))


@query("j12_label_tables", with_tables(
    f"SELECT {ID}, a.class, b.pred_class FROM (SELECT {ID}, class FROM s) a LEFT JOIN (SELECT {ID}, pred_class FROM s WHERE p_gain > 0.3) b "
    f"USING ({ID})", **S))
def label_tables(spark, sf):
    s = lake.scored(spark, sf)
    return joins.label_tables(s.select("query_id", "candidate_id", "class"),
                              s.where("p_gain > 0.3").select("query_id", "candidate_id", "pred_class"))


# ---- labels ----------------------------------------------------------------------------------

@query("l01_global_threshold", with_tables(
    f"SELECT {ID}, CASE WHEN gain > 0.7 THEN 'gain' ELSE 'loss' END AS label FROM s", **S))
def global_label(spark, sf):
    return labels.by_threshold(lake.scored(spark, sf), 0.7, out="label").select(
        "query_id", "candidate_id", "label")


@query("l02_mean_and_median", with_tables(
    f"SELECT {ID}, CASE WHEN gain > m AND gain > 0 THEN 'gain' ELSE 'loss' END AS class_mean, CASE WHEN gain > d AND gain > 0 THEN "
    f"'gain' ELSE 'loss' END AS class_median FROM s JOIN (SELECT {Q}, avg(gain) AS m, median(gain) AS d FROM s GROUP BY ALL) "
    f"USING ({Q})", **S))
def mean_median(spark, sf):
    return labels.by_query_average(lake.scored(spark, sf)).select(
        "query_id", "candidate_id", "class_mean", "class_median")


_GRAD = (
    f"SELECT {PKEY}, gain, i, n, gradient, lead(gradient) OVER (PARTITION BY {Q} ORDER BY i) AS nextg FROM (SELECT *, "
    f"coalesce(gain - lag(gain) OVER (PARTITION BY {Q} ORDER BY i), '-infinity'::DOUBLE) AS gradient FROM (SELECT *, "
    f"row_number() OVER (PARTITION BY {Q} ORDER BY gain, candidate_id) - 1 AS i, count(*) OVER (PARTITION BY {Q}) AS n FROM s))")


@query("l03_gradients", with_tables(f"SELECT {ID}, i, n, CASE WHEN i > 0 THEN gradient END AS gradient FROM ({_GRAD})", **S))
def gradients(spark, sf):
    g = labels.gradients(lake.scored(spark, sf))
    return g.select("query_id", "candidate_id", "i", "n",
                    F.when(F.col("i") > 0, F.col("gradient")).alias("gradient"))


_OOM = "CASE WHEN gain = 0 THEN '-infinity'::DOUBLE ELSE floor(log10(abs(gain))) END"
_POLICIES = (
    f"WITH s AS ({lake.SCORED_SQL}), g AS (SELECT *, {_OOM} AS oom FROM ({_GRAD})), "
    f"tops AS (SELECT {Q}, oom AS top FROM g WHERE i = n - 1), "
    f"falls AS (SELECT {Q}, i, row_number() OVER (PARTITION BY {Q} ORDER BY i DESC) AS k FROM g WHERE gradient < nextg), "
    f"b AS (SELECT {Q}, (SELECT max(i) FROM falls f WHERE f.query_id = t.query_id AND f.target = t.target) AS h, "
    "(SELECT min(i) FROM falls f WHERE f.query_id = t.query_id AND f.target = t.target AND k <= 2) AS n2, "
    "(SELECT max(i) FROM g WHERE g.query_id = t.query_id AND g.target = t.target AND g.oom < t.top) AS o FROM tops t) "
    f"SELECT {ID}, " + ", ".join(
        f"CASE WHEN i > {e} AND gain > 0 THEN 'gain' ELSE 'loss' END AS {n}" for n, e in {
            "harsh_grad_class": "coalesce(h, -1)", "second_grad_drop_class": "coalesce(n2, -1)",
            "order_of_mag_drop_class": "coalesce(o, -1)", "median_based_class": "ceil(n / 2)"}.items())
    + f" FROM g JOIN b USING ({Q})")


@query("l04_l08_all_policies", _POLICIES)
def policies(spark, sf):
    return labels.all_policies(lake.scored(spark, sf)).select(
        "query_id", "candidate_id", "harsh_grad_class",
        F.col("2th_grad_drop_class").alias("second_grad_drop_class"), "order_of_mag_drop_class",
        "median_based_class")


# ---- scores given ----------------------------------------------------------------------------

@query("m07_m09_improvements", with_tables(
    f"SELECT {ID}, r2_after > r2_before AS r2_improved, (r2_after - r2_before) / abs(nullif(r2_before, 0)) AS gain_in_r2_score, "
    f"r2_after - r2_before AS absolute_gain FROM t", t=lake.INSTANCES_SQL))
def improvements(spark, sf):
    t = lake.instances(spark, sf)
    return t.select("query_id", "candidate_id", (F.col("r2_after") > F.col("r2_before")).alias("r2_improved"),
                    scores.relative_gain("r2_before", "r2_after").alias("gain_in_r2_score"),
                    scores.absolute_gain("r2_before", "r2_after").alias("absolute_gain"))


@query("m10_adjusted_r2", with_tables(
    f"SELECT {ID}, " + rs("1 - (1 - r2_after) * (n - 1) / (n - p - 1)", 8) + " AS adjusted FROM (SELECT *, 30 AS n, "
    "1 + (price::BIGINT % 5) AS p FROM t)", t=lake.INSTANCES_SQL))
def adjusted(spark, sf):
    t = lake.instances(spark, sf)
    p = 1 + F.round("price").cast("long") % 5
    return t.select("query_id", "candidate_id", rnd(scores.adjusted_r2(
        F.col("r2_after"), F.lit(30), p), 8).alias("adjusted"))


@query("m17_both_say_gain", with_tables(
    f"SELECT {ID}, CASE WHEN pred_class = 'gain' AND containment > 0.5 THEN 'gain' ELSE 'loss' END AS both_class FROM s", **S))
def both_say(spark, sf):
    from joinlift.operators import metamodel
    s = lake.scored(spark, sf).withColumn("second", labels.label(F.col("containment") > 0.5))
    return s.select("query_id", "candidate_id",
                    metamodel.both_positive("pred_class", "second").alias("both_class"))


@query("m18_nearest_centroid", with_tables(
    f"SELECT {ID}, CASE WHEN (containment - gc) ** 2 + (pearson_difference - gp) ** 2 < (containment - lc) ** 2 + "
    "(pearson_difference - lp) ** 2 THEN 'gain' ELSE 'loss' END AS pred FROM s, (SELECT avg(containment) FILTER (class = 'gain') AS gc, "
    "avg(pearson_difference) FILTER (class = 'gain') AS gp, avg(containment) FILTER (class = 'loss') AS lc, "
    "avg(pearson_difference) FILTER (class = 'loss') AS lp FROM s)", **S))
def centroid(spark, sf):
    from joinlift.operators import metamodel
    s = lake.scored(spark, sf)
    out = metamodel.nearest_centroid(s, s, ["containment", "pearson_difference"], "class")
    return out.select("query_id", "candidate_id", "pred")


# ---- rankings --------------------------------------------------------------------------------

def _rk(score):
    return f"row_number() OVER (PARTITION BY {Q} ORDER BY {score} DESC, candidate_id)"


_RANKED = (f"SELECT *, {_rk('gain')} AS real_rank, {_rk('predicted_gain')} AS pred_rank, {_rk('containment')} AS cont_rank, "
           f"{_rk('pearson_difference')} AS pear_rank, count(*) OVER (PARTITION BY {Q}) AS n FROM s")
R = dict(s=lake.SCORED_SQL, r=_RANKED)
_SCORES = {"real_rank": "gain", "pred_rank": "predicted_gain"}


def _ranked(spark, sf, extra=None):
    by = {**_SCORES, **(extra or {})}
    return rank.rank_candidates(lake.scored(spark, sf).select(*PAIR, *by.values()), by)


@query("r01_rankings", with_tables(f"SELECT {ID}, real_rank, pred_rank, cont_rank, pear_rank FROM r", **R))
def rankings(spark, sf):
    return _ranked(spark, sf, {"cont_rank": "containment", "pear_rank": "pearson_difference"}).select(
        "query_id", "candidate_id", "real_rank", "pred_rank", "cont_rank", "pear_rank")


def report_sql(group=""):
    g = f"{group}, " if group else ""
    return (
        f"per AS (SELECT {g}c AS class, coalesce(hits / nullif(said, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, "
        f"coalesce(2 * hits / nullif(said + support, 0), 0) AS f1, support, hits FROM (SELECT {g}c, count(*) FILTER (pred_class = c) AS said, "
        f"count(*) FILTER (class = c) AS support, count(*) FILTER (class = c AND pred_class = c) AS hits FROM s, (VALUES ('gain'), ('loss')) t(c) GROUP BY ALL)) "
        f"SELECT {g}class, {rs('precision', 8)} AS precision, {rs('recall', 8)} AS recall, {rs('f1', 8)} AS f1, support FROM per UNION ALL "
        f"SELECT {g}'accuracy', {rs('sum(hits) / sum(support)', 8)}, {rs('sum(hits) / sum(support)', 8)}, {rs('sum(hits) / sum(support)', 8)}, "
        f"sum(support)::BIGINT FROM per {'GROUP BY ' + group if group else ''} UNION ALL SELECT {g}'macro avg', {rs('avg(precision)', 8)}, {rs('avg(recall)', 8)}, "
        f"{rs('avg(f1)', 8)}, sum(support)::BIGINT FROM per {'GROUP BY ' + group if group else ''} UNION ALL SELECT {g}'weighted avg', "
        + ", ".join(rs(f"sum({c} * support) / sum(support)", 8) for c in ("precision", "recall", "f1"))
        + f", sum(support)::BIGINT FROM per {'GROUP BY ' + group if group else ''}")


@query("r02_classification_report", f"WITH s AS ({lake.SCORED_SQL}), {report_sql()}")
def class_report(spark, sf):
    out = report.classification_report(lake.scored(spark, sf), "class", "pred_class")
    return out.withColumns({c: rnd(c, 8) for c in ("precision", "recall", "f1")})


@query("r02_report_per_query", f"WITH s AS ({lake.SCORED_SQL}), {report_sql('query_id')}")
def class_report_per_query(spark, sf):
    out = report.classification_report(lake.scored(spark, sf), "class", "pred_class", ["query_id"])
    return out.withColumns({c: rnd(c, 8) for c in ("precision", "recall", "f1")})


_TAG = ("CASE WHEN class = 'gain' AND pred_class = 'gain' THEN 'tp' WHEN class = 'gain' THEN 'fn' WHEN pred_class = 'gain' THEN 'fp' "
        "ELSE 'tn' END")


@query("r03_outcomes", with_tables(
    f"SELECT query_id, tp, fp, tn, fn, {rs('coalesce(tp / nullif(tp + fp, 0), 0)', 9)} AS precision, "
    f"{rs('coalesce(tp / nullif(tp + fn, 0), 0)', 9)} AS recall FROM (SELECT query_id, " + ", ".join(
        f"count(*) FILTER (o = '{t}') AS {t}" for t in ("tp", "fp", "tn", "fn")) + f" FROM (SELECT *, {_TAG} AS o FROM s) GROUP BY 1)", **S))
def outcomes(spark, sf):
    out = report.precision_recall(report.outcome_tags(lake.scored(spark, sf), "class", "pred_class"), ["query_id"])
    return out.withColumns({c: rnd(c, 9) for c in ("precision", "recall")})


def _ndcg_sql(rel):
    r = f"CASE WHEN real_rank <= 5 THEN {rel} ELSE 0 END"
    return with_tables(
        f"SELECT {Q}, {rs(f'sum({r} / log2(pred_rank + 1)) / nullif(sum({r} / log2(real_rank + 1)), 0)', 8)} AS ndcg FROM r GROUP BY ALL", **R)


@query("r04_ndcg_by_rank", _ndcg_sql("least(5, n) - real_rank + 1"))
def ndcg(spark, sf):
    return rank.ndcg(_ranked(spark, sf)).withColumn("ndcg", rnd("ndcg", 8))


@query("r04_ndcg_by_gain", _ndcg_sql("greatest(gain, 0)"))
def ndcg_gain(spark, sf):
    return rank.ndcg(_ranked(spark, sf), gain="gain").withColumn("ndcg", rnd("ndcg", 8))


@query("r05_reciprocal_rank", with_tables(
    f"SELECT {Q}, {rs('1 / pred_rank', 9)} AS reciprocal_rank FROM r WHERE real_rank = 1", **R))
def mrr(spark, sf):
    return rank.reciprocal_rank(_ranked(spark, sf)).withColumn("reciprocal_rank", rnd("reciprocal_rank", 9))


@query("r06_precision", with_tables(
    f"SELECT {Q}, {rs('count(*) FILTER (real_rank <= 5 AND pred_rank <= 5) / 5', 9)} AS precision_at_5, "
    f"{rs('count(*) FILTER (gain > 0 AND pred_rank <= k) / nullif(any_value(k), 0)', 9)} AS r_precision FROM r JOIN "
    f"(SELECT {Q}, count(*) FILTER (gain > 0) AS k FROM s GROUP BY ALL) USING ({Q}) GROUP BY ALL", **R))
def precision(spark, sf):
    ranked = _ranked(spark, sf)
    both = rank.precision_at(ranked, 5).join(rank.r_precision(ranked), ["query_id", "target"])
    return both.select("query_id", "target", rnd("precision_at_k", 9).alias("precision_at_5"),
                       rnd("r_precision", 9).alias("r_precision"))


_AP = (f"SELECT {Q}, avg(hits / k) AS ap FROM (SELECT {Q}, k, count(m) FILTER (m <= k) AS hits FROM (SELECT {Q}, greatest(real_rank, pred_rank) AS m "
       f"FROM r) JOIN (SELECT {Q}, pred_rank AS k FROM r) USING ({Q}) GROUP BY ALL) GROUP BY ALL")


@query("r07_average_precision", with_tables(f"SELECT {Q}, {rs('ap', 8)} AS average_precision FROM ({_AP})", **R))
def average_precision(spark, sf):
    return rank.average_precision(_ranked(spark, sf)).withColumn(
        "average_precision", rnd("average_precision", 8))


_RECIPES = {"classifier_regressor": ("pred_class = 'gain'", "predicted_gain"),
            "certain_regressor": ("pred_class = 'gain' AND p_gain > 0.6", "predicted_gain"),
            "classifier_containment": ("pred_class = 'gain'", "containment"),
            "certain_containment": ("pred_class = 'gain' AND p_gain > 0.6", "containment"),
            "classifier_pearson": ("pred_class = 'gain'", "pearson_difference"),
            "certain_pearson": ("pred_class = 'gain' AND p_gain > 0.6", "pearson_difference"),
            "containment": ("true", "containment"), "regressor": ("true", "predicted_gain")}
_CURVES = (
    f"WITH s AS ({lake.SCORED_SQL}), ok AS (SELECT {Q}, count(*) FILTER (class = 'gain') AS np, count(*) FILTER (class = 'gain' AND gain > 1) AS n1 "
    "FROM s GROUP BY ALL HAVING np > 0 AND count(*) FILTER (pred_class = 'gain') > 0 AND count(*) FILTER (pred_class = 'gain' AND p_gain > 0.6) > 0), "
    f"rr AS (SELECT {PKEY}, row_number() OVER (PARTITION BY {Q} ORDER BY gain DESC, candidate_id) AS rr FROM s WHERE class = 'gain'), "
    "p AS (" + " UNION ALL ".join(
        f"SELECT {PKEY}, gain, '{n}' AS recipe, row_number() OVER (PARTITION BY {Q} ORDER BY {sc} DESC, candidate_id) AS pr, "
        f"count(*) OVER (PARTITION BY {Q}) AS nr FROM s WHERE {w}" for n, (w, sc) in _RECIPES.items())
    + f"), x AS (SELECT p.*, rr, np, n1 FROM p JOIN ok USING ({Q}) LEFT JOIN rr USING ({PKEY})), "
    "k AS (SELECT unnest(range(51))::INTEGER AS k), "
    f"c AS (SELECT {Q}, recipe, k, least(k, nr) AS got, np, least(k, n1) AS m, nr, "
    "count(*) FILTER (rr IS NOT NULL AND pr <= k) AS h, "
    "count(*) FILTER (gain > 1 AND greatest(rr, pr) <= least(k, n1)) AS h1, count(*) FILTER (gain > 0 AND greatest(rr, pr) <= k) AS h0 "
    f"FROM x, k WHERE pr <= 50 GROUP BY {Q}, recipe, k, nr, np, n1) SELECT recipe, k, " + ", ".join(
        f"{rs(f'avg({e})', 8)} AS {n}" for n, e in {
            "precision": "h / nullif(got, 0)", "recall": "CASE WHEN got > 0 THEN h / np END",
            "strict_r_precision": "h1 / nullif(least(m, nr), 0)", "r_recall": "h0 / nullif(got, 0)"}.items())
    + ", count(*) AS n_queries FROM c GROUP BY ALL")


@query("r08_retrieval_curves", _CURVES)
def curves(spark, sf):
    out = rank.retrieval_curves(lake.scored(spark, sf))
    return out.withColumns({c: rnd(c, 8) for c in ("precision", "recall", "strict_r_precision", "r_recall")})


# all pairs of one query's candidates meet here in DuckDB only
_TAU = (f"SELECT {Q}, sum(sign(a.{{0}} - b.{{0}}) * sign(a.{{1}} - b.{{1}})) / count(*) AS tau FROM r a JOIN r b USING ({Q}) "
        "WHERE a.candidate_id <> b.candidate_id GROUP BY ALL")


@query("r09_kendall_of_rankings", with_tables(
    f"SELECT {Q}, {rs('tau', 8)} AS kendall_tau FROM ({_TAU.format('real_rank', 'pred_rank')})", **R))
def tau(spark, sf):
    return rank.kendall_of_rankings(_ranked(spark, sf)).withColumn("kendall_tau", rnd("kendall_tau", 8))


@query("r10_recall_per_query", with_tables(
    f"SELECT {Q}, count(*) FILTER (class = 'gain') AS n_real, count(*) FILTER (class = 'gain' AND pred_class = 'gain') AS n_found, "
    + rs("count(*) FILTER (class = 'gain' AND pred_class = 'gain') / count(*) FILTER (class = 'gain')", 9)
    + " AS found_share FROM s GROUP BY ALL HAVING count(*) FILTER (class = 'gain') > 0", **S))
def found(spark, sf):
    return report.recall_per_query(lake.scored(spark, sf), "class", "pred_class").withColumn(
        "found_share", rnd("found_share", 9))


@query("r10_top_gain_recall", with_tables(
    f"SELECT {Q}, {rs('count(*) FILTER (pred_class = ' + chr(39) + 'gain' + chr(39) + ') / 5', 9)} AS top_recall FROM r WHERE real_rank <= 5 AND gain > 0 "
    "GROUP BY ALL HAVING count(*) >= 5", **R))
def top_recall(spark, sf):
    return report.top_gain_recall(lake.scored(spark, sf), 5, "pred_class").withColumn(
        "top_recall", rnd("top_recall", 9))


@query("a16_candidates_per_query", with_tables(
    f"SELECT count(*) AS n_queries, {rs('avg(c)', 9)} AS mean_candidates, {rs('median(c)', 9)} AS median_candidates FROM "
    f"(SELECT {Q}, count(*) AS c FROM s GROUP BY ALL)", **S))
def per_query(spark, sf):
    out = report.candidates_per_query(lake.scored(spark, sf))
    return out.withColumns({c: rnd(c, 9) for c in ("mean_candidates", "median_candidates")})


def _one_ranking(name, col):
    return (
        f"SELECT '{name}' AS ranking, {Q}, tau, p1, p5, rp, ap, nd FROM ({_TAU.format('real_rank', col)}) JOIN "
        f"(SELECT {Q}, count(*) FILTER (real_rank <= 1 AND {col} <= 1)::DOUBLE AS p1, count(*) FILTER (real_rank <= 5 AND {col} <= 5) / 5 AS p5, "
        f"count(*) FILTER (gain > 0 AND {col} <= k) / nullif(any_value(k), 0) AS rp, "
        f"sum(CASE WHEN real_rank <= 5 THEN least(5, n) - real_rank + 1 ELSE 0 END / log2({col} + 1)) / "
        "nullif(sum(CASE WHEN real_rank <= 5 THEN least(5, n) - real_rank + 1 ELSE 0 END / log2(real_rank + 1)), 0) AS nd FROM r JOIN "
        f"(SELECT {Q}, count(*) FILTER (gain > 0) AS k FROM s GROUP BY ALL) USING ({Q}) GROUP BY ALL) USING ({Q}) JOIN "
        f"({_AP.replace('pred_rank', col)}) USING ({Q})")


@query("r11_ranking_report", with_tables(
    f"SELECT ranking, " + ", ".join(f"{rs(f'avg({e})', 8)} AS {n}" for n, e in {
        "kendall_tau": "tau", "precision_at_1": "p1", "precision_at_5": "p5", "r_precision": "rp", "map": "ap", "ndcg": "nd"}.items())
    + ", count(*) AS n_queries FROM (" + " UNION ALL ".join(_one_ranking(n, c) for n, c in (
        ("model", "pred_rank"), ("containment", "cont_rank"), ("pearson", "pear_rank"))) + ") GROUP BY ALL", **R))
def ranking_report(spark, sf):
    out = rank.ranking_report(lake.scored(spark, sf), {
        "model": "predicted_gain", "containment": "containment", "pearson": "pearson_difference"})
    return out.withColumns({c: rnd(c, 8) for c in (
        "kendall_tau", "precision_at_1", "precision_at_5", "r_precision", "map", "ndcg")})


_SAPE = "2 * abs(predicted_gain - gain) / nullif(abs(gain) + abs(predicted_gain), 0)"


@query("r12_prediction_errors", with_tables(
    f"SELECT {Q}, {rs('avg((predicted_gain - gain) * (predicted_gain - gain))', 6)} AS mse, {rs(f'100 * avg(coalesce({_SAPE}, 0))', 6)} AS smape, "
    "count(*) AS n FROM s GROUP BY ALL", **S))
def errors(spark, sf):
    out = report.prediction_errors(lake.scored(spark, sf), "gain", "predicted_gain", ["query_id", "target"])
    return out.withColumns({c: rnd(c, 6) for c in ("mse", "smape")})


@query("r12_error_distributions", with_tables(
    f"SELECT {ID}, {rs('e / max(e) OVER ()', 9)} AS squared_error, {rs('q / max(q) OVER ()', 9)} AS sape FROM (SELECT {ID}, "
    f"(predicted_gain - gain) * (predicted_gain - gain) AS e, {_SAPE} AS q FROM s)", **S))
def error_dist(spark, sf):
    out = report.error_distributions(lake.scored(spark, sf), "gain", "predicted_gain", normalise=True)
    return out.select("query_id", "candidate_id", rnd("squared_error", 9).alias("squared_error"),
                      rnd("sape", 9).alias("sape"))


@query("r13_quadrants", with_tables(
    "SELECT CASE WHEN gain > 0 AND predicted_gain > 0 THEN 1 WHEN predicted_gain > 0 THEN 2 WHEN gain <= 0 THEN 3 ELSE 4 END AS quadrant, "
    "count(*) AS n FROM s GROUP BY 1", **S))
def quadrants(spark, sf):
    return report.quadrants(lake.scored(spark, sf), "gain", "predicted_gain")


_HIST = ("SELECT {g}, coalesce(least(floor((v - lo) / nullif(hi - lo, 0) * {b}) + 1, {b}), 1)::BIGINT AS bin, count(*) AS n, "
         "any_value(t) AS t FROM x JOIN (SELECT {g}, min(v) AS lo, max(v) AS hi, count(*) AS t FROM x GROUP BY 1) USING ({g}) GROUP BY 1, 2")


@query("r14_compare_distributions", with_tables(
    f"SELECT class, bin, n, {rs('n / t', 9)} AS share FROM ({_HIST.format(g='class', b=50)})",
    s=lake.SCORED_SQL,
    m="SELECT class, median(price) AS m FROM s GROUP BY 1",
    d="SELECT class, any_value(m) AS m, median(abs(price - m)) * 1.4826 AS d FROM s JOIN m USING (class) GROUP BY 1",
    x="SELECT class, price AS v FROM s JOIN d USING (class) WHERE abs(price - m) / d < 2"))
def compare(spark, sf):
    out = report.compare_distributions(lake.scored(spark, sf), "class", "price",
                                       spread=["query_id", "candidate_id"])
    return out.withColumn("share", rnd("share", 9))


@query("r15_probability_histogram", with_tables(
    "SELECT least(floor(p_gain * 20) + 1, 20)::BIGINT AS bin, count(*) AS n, "
    f"{rs('count(*) / (SELECT count(*) FROM s)', 9)} AS share FROM s GROUP BY 1", **S))
def prob_hist(spark, sf):
    return report.probability_histogram(lake.scored(spark, sf)).withColumn("share", rnd("share", 9))


@query("r15_uncertain_share", with_tables(
    f"SELECT count(*) AS n, {rs('avg((p_gain BETWEEN 0.4 AND 0.6)::INTEGER)', 9)} AS uncertain_share FROM s", **S))
def uncertain_share(spark, sf):
    return report.uncertain_share(lake.scored(spark, sf)).withColumn("uncertain_share", rnd("uncertain_share", 9))


@query("r16_predicted_list", with_tables(
    f"SELECT {PKEY}, p_gain, gain, containment FROM s WHERE pred_class = 'gain'", **S))
def predicted(spark, sf):
    return report.predicted_list(lake.scored(spark, sf))


@query("u09_unpruned", with_tables(f"SELECT {PKEY} FROM s", **S))
def unpruned(spark, sf):
    return prune.unpruned(lake.scored(spark, sf))


@query("u10_pruning_power", with_tables(
    f"SELECT {Q}, count(*) AS n_relevant, count(*) FILTER (rk <= 20) AS n_kept, {rs('count(*) FILTER (rk <= 20) / count(*)', 9)} AS power "
    f"FROM (SELECT *, {_rk('containment')} AS rk FROM s) WHERE class = 'gain' GROUP BY ALL", **S))
def power(spark, sf):
    s = lake.scored(spark, sf)
    out = prune.pruning_power(prune.keep_best(s, "containment", n=20), s.where("class = 'gain'"))
    return out.withColumn("power", rnd("power", 9))


@query("s15_shuffle_in_hash_order", with_tables(
    f"SELECT {ID}, row_number() OVER (PARTITION BY class ORDER BY {md5_sql('any', 'query_id', 'candidate_id')}, {ID}) - 1 AS pos FROM s", **S))
def shuffled(spark, sf):
    out = hash_order(lake.scored(spark, sf), ["class"], ["query_id", "candidate_id"], seed="any")
    return out.select("query_id", "candidate_id", "pos")
