"""User-model scores, metamodels, pruners and selectors on the test lake."""

from pyspark.sql import functions as F

from joinlift.functions import materialise
from joinlift.operators import instances, labels, metamodel, prune, scores, select, splits
from joinlift.operators.report import classification_report
from joinlift.plans import runs, testlake as lake
from joinlift.plans.assoc_queries import ALIGNED
from joinlift.plans.pair_queries import report_sql
from joinlift.plans.registry import hash_sql, query, rnd, rnd_sql as rs, with_tables
from joinlift.schema import PAIR

# Boosting is sequential, so its queries run fewer rounds than the operator's default of 100.
FEWER_ROUNDS = dict(trees=20)
SCORED_FEATURES = ["containment", "pearson_difference", "predicted_gain", "price", "p_gain"]

# ---- scores of the user model; DuckDB solves the 2 x 2 system in closed form ---------------------

_PAIRS_SQL = ("SELECT * FROM (VALUES ('customer', 'c_acctbal', 'cust_orders/n_orders'), ('customer', 'c_acctbal', 'cust_orders/avg_price'), "
              "('customer', 'c_acctbal', 'user_events/sum_value'), ('orders', 'o_totalprice', 'order_lines/sum_price'), "
              "('orders', 'o_totalprice', 'order_lines/avg_discount')) x(query_id, target, candidate_id)")
_M1_CELLS = (lake.cells_sql("customer", "orders") + " UNION ALL "
             + lake.single_cells_sql("cust_orders", "user_events", "order_lines"))
_XY = ("SELECT r.query_id, r.candidate_id, r.y, q.v AS a, r.x AS b, " + hash_sql("42", "r.row_key") + " % 100 < 67 AS tr FROM rows r "
       "JOIN cells q ON q.dataset_id = r.query_id AND q.row_key = r.row_key AND q.col <> r.target")
_FIT = ("SELECT query_id, candidate_id, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, y) / var_pop(a) AS s, "
        "(covar_pop(a, y) * var_pop(b) - covar_pop(b, y) * covar_pop(a, b)) / (var_pop(a) * var_pop(b) - covar_pop(a, b) ** 2) AS ba, "
        "(covar_pop(b, y) * var_pop(a) - covar_pop(a, y) * covar_pop(a, b)) / (var_pop(a) * var_pop(b) - covar_pop(a, b) ** 2) AS bb "
        "FROM xy WHERE tr GROUP BY ALL")
_ERR = ("SELECT query_id, candidate_id, avg(abs(y - {p})) AS mae, avg((y - {p}) ** 2) AS mse, median(abs(y - {p})) AS medae, "
        "1 - avg((y - {p}) ** 2) / var_pop(y) AS r2 FROM xy JOIN fit USING (query_id, candidate_id) WHERE NOT tr GROUP BY ALL")
_BEFORE, _AFTER = _ERR.format(p="(my + s * (a - ma))"), _ERR.format(p="(my + ba * (a - ma) + bb * (b - mb))")


def _score_columns(f):
    return {f"{m}_{s}": f(m, s) for m in ("mae", "medae", "r2") for s in ("before", "after")}


def _m1_inputs(spark, sf):
    cells = materialise(lake.cells(spark, sf, "customer", "orders").unionByName(
        lake.single_cells(spark, sf, "cust_orders", "user_events", "order_lines")))
    pairs = spark.createDataFrame([
        ("customer", "c_acctbal", "cust_orders/n_orders"), ("customer", "c_acctbal", "cust_orders/avg_price"),
        ("customer", "c_acctbal", "user_events/sum_value"), ("orders", "o_totalprice", "order_lines/sum_price"),
        ("orders", "o_totalprice", "order_lines/avg_discount")], "query_id string, target string, candidate_id string")
    return pairs, cells


@query("m01_scores_before_and_after", with_tables(
    "SELECT query_id, candidate_id, " + ", ".join(
        f"{rs(f'{s}.{m}', 6 if m == 'r2' else 2)} AS {m}_{t}" for m in ("mae", "medae", "r2")
        for s, t in (("p", "before"), ("n", "after")))
    + f", {rs('sqrt(p.mse)', 2)} AS rmse_before, {rs('sqrt(n.mse)', 2)} AS rmse_after FROM ({_BEFORE}) p JOIN ({_AFTER}) n USING (query_id, candidate_id)",
    cells=_M1_CELLS, pairs=_PAIRS_SQL, rows=ALIGNED, xy=_XY, fit=_FIT))
def before_after(spark, sf):
    out = scores.before_and_after(*_m1_inputs(spark, sf))
    return out.select("query_id", "candidate_id", *[
        rnd(f"{m}_{s}", 6 if m == "r2" else 2).alias(f"{m}_{s}") for m in ("mae", "medae", "r2")
        for s in ("before", "after")], *[rnd(F.sqrt(f"mse_{s}"), 2).alias(f"rmse_{s}") for s in ("before", "after")])


# Every single column of every candidate, for the two bases that have one feature besides their target.
_EVERY_CANDIDATE = ("cust_orders", "user_events", "order_lines")
_EVERY_PAIR = ("SELECT b.*, c.candidate_id FROM (VALUES ('customer', 'c_acctbal'), ('orders', 'o_totalprice')) b(query_id, target) "
               f"CROSS JOIN (SELECT DISTINCT dataset_id AS candidate_id FROM ({lake.single_cells_sql(*_EVERY_CANDIDATE)})) c")
_MATCHED = ("SELECT p.query_id, p.candidate_id, q.row_key, q.v AS y, a.v AS a, c.v AS x, " + hash_sql("42", "q.row_key") + " % 100 < 67 AS tr "
            "FROM pairs p JOIN cells q ON q.dataset_id = p.query_id AND q.col = p.target "
            "JOIN cells a ON a.dataset_id = p.query_id AND a.col <> p.target AND a.row_key = q.row_key "
            "LEFT JOIN cells c ON c.dataset_id = p.candidate_id AND c.row_key = q.row_key")
_FILLS = ("SELECT query_id, candidate_id, unnest(['mean', 'median', 'most_frequent']) AS strategy, unnest([avg(x), median(x), "
          "min(x) FILTER (c = m)]) AS f FROM (SELECT *, max(c) OVER (PARTITION BY query_id, candidate_id) AS m FROM (SELECT *, "
          "CASE WHEN x IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY query_id, candidate_id, x) END AS c FROM matched)) GROUP BY 1, 2")
_EACH = ("SELECT m.query_id || '>' || m.candidate_id || '>' || strategy AS query_id, m.candidate_id, y, a, coalesce(x, f, 0) AS b, tr "
         "FROM matched m JOIN fills USING (query_id, candidate_id)")


@query("i01_best_strategy", with_tables(
    "SELECT split_part(query_id, '>', 1) AS query_id, candidate_id, split_part(query_id, '>', 3) AS strategy, "
    f"{rs('mae_before', 2)} AS mae_before, {rs('mae', 2)} AS mae_after, {rs('r2', 6)} AS r2_after FROM (SELECT *, row_number() OVER "
    "(PARTITION BY split_part(query_id, '>', 1), candidate_id ORDER BY split_part(query_id, '>', 3)) AS k FROM (SELECT n.*, p.mae AS mae_before, "
    "min(n.mae) OVER (PARTITION BY split_part(query_id, '>', 1), candidate_id) AS least "
    f"FROM ({_AFTER}) n JOIN ({_BEFORE}) p USING (query_id, candidate_id)) WHERE mae <= least * (1 + 1e-9)) WHERE k = 1",
    cells=_M1_CELLS, pairs=_EVERY_PAIR, matched=_MATCHED, fills=_FILLS, xy=_EACH, fit=_FIT))
def best_imputation(spark, sf):
    """Every candidate column under the imputation that suits it best."""
    found = materialise(lake.single_cells(spark, sf, *_EVERY_CANDIDATE))
    bases = F.array(*[F.struct(F.lit(q).alias("query_id"), F.lit(t).alias("target")) for q, t in lake.QUERIES if q in ("customer", "orders")])
    pairs = found.select(F.col("dataset_id").alias("candidate_id")).distinct().select("candidate_id", F.inline(bases))
    best = scores.with_best_imputation(pairs, lake.cells(spark, sf, "customer", "orders").unionByName(found))
    return best.select("query_id", "candidate_id", "strategy", rnd("mae_before", 2).alias("mae_before"),
                       rnd("mae_after", 2).alias("mae_after"), rnd("r2_after", 6).alias("r2_after"))


@query("m01_user_model_forest")
def forest_scores(spark, sf):
    """The same pairs under a random forest as the user's model."""
    return scores.before_and_after_with("random forest", *_m1_inputs(spark, sf))


@query("m01_ground_truth_records")
def ground_truth(spark, sf):
    """Sources -> splits -> positive and negative pairs -> scores -> training records."""
    return runs.make_ground_truth(lake.sources(spark, sf), lake.SOURCE_TARGETS, max_splits=3, max_columns=10, negatives=2)


_M8 = {"decrease_in_mae": "mae", "decrease_in_mse": "mse", "decrease_in_medae": "medae", "gain_in_r2_score": "r2"}


@query("m08_relative_targets", with_tables(
    "SELECT query_id, candidate_id, " + ", ".join(
        rs(f"(n.{m} - p.{m}) / " + (f"abs(nullif(p.{m}, 0))" if m == "r2" else f"nullif(p.{m}, 0)"), 3 if m == "r2" else 7) + f" AS {name}"
        for name, m in _M8.items())
    + ", " + ", ".join(f"n.{m} {'>' if m == 'r2' else '<'} p.{m} AS {m}_improved" for m in _M8.values())
    + f" FROM ({_BEFORE}) p JOIN ({_AFTER}) n USING (query_id, candidate_id)", cells=_M1_CELLS, pairs=_PAIRS_SQL, rows=ALIGNED, xy=_XY, fit=_FIT))
def relative(spark, sf):
    out = scores.improvement_flags(scores.relative_targets(scores.before_and_after(*_m1_inputs(spark, sf))))
    return out.select("query_id", "candidate_id", *[rnd(name, 3 if m == "r2" else 7).alias(name) for name, m in _M8.items()],
                      *[f"{m}_improved" for m in _M8.values()])


def _train_test(spark, sf):
    s = materialise(splits.split_by_hash(lake.scored(spark, sf), ["query_id"]))
    return s.where("part = 'train'").drop("part"), s.where("part = 'test'").drop("part")


def _rounds(kind):
    return FEWER_ROUNDS if kind == "boosted trees" else {}


def _regression(kind):
    def run(spark, sf):
        train, test = _train_test(spark, sf)
        model = metamodel.train_regressor(train, SCORED_FEATURES, kind=kind, **_rounds(kind))
        scored = metamodel.apply_regressor(model, test, SCORED_FEATURES)
        return scores.error_scores(materialise(scored.select("target", F.col("gain").alias("y"),
                                                             F.col("score").alias("yhat"))), ["target"])
    return run


for _name, _kind in {"m02_linear_regression": "linear", "m03_random_forest": "random forest",
                     "m04_gradient_linear": "sgd", "m05_boosted_trees": "boosted trees",
                     "m06_decision_tree": "decision tree"}.items():
    query(_name)(_regression(_kind))


def _classification(kind):
    def run(spark, sf):
        train, test = _train_test(spark, sf)
        model = metamodel.train_classifier(train, SCORED_FEATURES, kind=kind, **_rounds(kind))
        scored = metamodel.apply_classifier(model, test.drop("pred_class"), SCORED_FEATURES)
        return scored.select("query_id", "candidate_id", "class", "pred_class", "score")
    return run


for _name, _kind in {"m11_metamodel_classifier": "random forest", "m05_boosted_classifier": "boosted trees",
                     "m13_linear_svm": "linear svm"}.items():
    query(_name)(_classification(_kind))


@query("m12_regressor_on_positives")
def on_positives(spark, sf):
    train, test = _train_test(spark, sf)
    model = metamodel.train_regressor(train, SCORED_FEATURES, above=0.0)
    return metamodel.apply_regressor(model, test, SCORED_FEATURES).select(
        "query_id", "candidate_id", "gain", "score")


@query("m14_cross_validation")
def cross_validation(spark, sf):
    return metamodel.cross_validate(lake.scored(spark, sf), 3, SCORED_FEATURES)[0]


@query("m15_mean_importances")
def importances(spark, sf):
    train, _ = _train_test(spark, sf)
    parts = [metamodel.importances(metamodel.train_classifier(train, SCORED_FEATURES, seed=s),
                                   spark, SCORED_FEATURES, str(s)) for s in (42, 17)]
    return metamodel.mean_importances(parts)


@query("m16_seed_flips")
def flips(spark, sf):
    train, test = _train_test(spark, sf)
    out = metamodel.seed_flips(train, test.drop("pred_class"), SCORED_FEATURES)
    return out.select("query_id", "candidate_id", "pred_0", "pred_1", "flips")


@query("m19_transfer")
def transfer(spark, sf):
    s = materialise(lake.scored(spark, sf).drop("pred_class"))
    corpora = {m: s.where(F.col("gain_marker") == m) for m in ("positive", "negative")}
    return metamodel.transfer(corpora, corpora, SCORED_FEATURES, mix=0.1)


@query("m20_alpha_grid")
def alpha_grid(spark, sf):
    train, test = _train_test(spark, sf)
    return metamodel.threshold_grid(train.drop("pred_class"), test.drop("pred_class"), SCORED_FEATURES,
                                    [0.0, 0.7, 1.5])


BETAS = [i / 100 for i in range(0, 50, 5)]
THETAS = [i / 20 for i in range(21)]


def _steps_sql(steps):
    return "(SELECT unnest([" + ", ".join(f"{v}::DOUBLE" for v in steps) + "]) AS \"at\")"


_GRIDS = with_tables(
    "", base=lake.SCORED_SQL, s=f"SELECT 'beta' AS grid, * FROM base, {_steps_sql(BETAS)} WHERE abs(p_gain - 0.5) > \"at\" UNION ALL "
      f"SELECT 'theta' AS grid, * FROM base, {_steps_sql(THETAS)} WHERE containment >= \"at\"").rstrip() + ", " + report_sql('grid, "at"')


def _grids(spark, sf):
    s = lake.scored(spark, sf)
    betas = metamodel.interval_grid(s, BETAS, "p_gain").withColumnRenamed("beta", "at")
    thetas = metamodel.theta_grid(s, THETAS).withColumnRenamed("theta", "at")
    return betas.withColumn("grid", F.lit("beta")).unionByName(thetas.withColumn("grid", F.lit("theta")))


@query("m20_beta_and_theta_grids", _GRIDS)
def beta_theta(spark, sf):
    return _grids(spark, sf).withColumns({c: rnd(c, 8) for c in ("precision", "recall", "f1")})


@query("m20_best_steps", f"SELECT grid, \"at\", f1 FROM (SELECT grid, \"at\", f1, row_number() OVER (PARTITION BY grid ORDER BY f1 DESC, \"at\") AS k "
       f"FROM ({_GRIDS}) WHERE class = 'gain') WHERE k = 1")
def best_steps(spark, sf):
    rounded = _grids(spark, sf).withColumn("f1", rnd("f1", 8))
    return metamodel.best_step(rounded, "at", group=["grid"])


@query("m21_principal_components")
def components(spark, sf):
    return metamodel.principal_components(lake.scored(spark, sf), SCORED_FEATURES, 2).select(
        "query_id", "candidate_id", "pc1", "pc2")


# ---- pruners on the nations' lake ----------------------------------------------------------------

def _nations(spark, sf):
    """Cells, feature vectors, and the labelled part; even nations train, odd ones are to be pruned."""
    cells = materialise(lake.nation_cells(spark, sf))
    pairs = materialise(lake.nation_pairs(cells).withColumn(
        "trains", F.regexp_extract("query_id", "[0-9]+", 0).cast("int") % 2 == 0))
    vectors = materialise(instances.feature_vectors(pairs.select(*PAIR), cells))
    train = pairs.where("trains").select(*PAIR)
    truth = scores.relative_targets(scores.before_and_after(train, cells)).withColumnRenamed(
        "gain_in_r2_score", "gain")
    known = materialise(labels.by_threshold(vectors.join(truth, PAIR), out="class"))
    return pairs.where("not trains").select(*PAIR), cells, vectors, known


@query("u03_classifier_pruner")
def classifier_pruner(spark, sf):
    pairs, _, vectors, known = _nations(spark, sf)
    model = metamodel.train_classifier(known)
    return prune.by_model(vectors.join(pairs, PAIR, "left_semi"), metamodel.scorer(model), n=3).select(
        *PAIR, "score", "rank")


@query("u04_regression_pruner")
def regression_pruner(spark, sf):
    pairs, _, vectors, known = _nations(spark, sf)
    model = metamodel.train_regressor(known)
    return prune.by_model(vectors.join(pairs, PAIR, "left_semi"), metamodel.scorer(model, regression=True),
                          n=3, min_score=float("-inf")).select(*PAIR, "score", "rank")


def _two_steps(**kw):
    def run(spark, sf):
        pairs, cells, _, known = _nations(spark, sf)
        return runs.hierarchical(pairs, cells, known, **kw).select(*PAIR, "score")
    return run


query("u05_hierarchical_pruner")(_two_steps(n=3))
query("u06_hierarchical_with_early_exit")(_two_steps(pruned_share=0.5, early_exit=True))
query("u07_hybrid_classifier_regressor")(_two_steps(n=3, regression=True, min_score=float("-inf")))


@query("u08_containment_then_classifier")
def hybrid(spark, sf):
    pairs, cells, _, known = _nations(spark, sf)
    model = metamodel.train_classifier(known)
    return prune.containment_then_model(pairs, cells, lambda p: instances.feature_vectors(p, cells),
                                        metamodel.scorer(model), n=2).select(*PAIR, "score", "rank")


@query("u11_prune_and_select_run")
def full_run(spark, sf):
    cells = materialise(lake.cells(spark, sf, "order_days", "ship_days", "event_days"))
    return runs.prune_and_select("order_days", "n_orders", lake.pairs(spark, "order_days").select(*PAIR), cells,
                                 pruner=lambda p: prune.by_containment(p, cells, 1), selector="elimination")


# A nation of few customers leaves features constant or dependent among its training rows, or one test row alone. Then a constant
# feature has no weight, two dependent ones share it equally (smallest norm, scaled), and R2 without variance is null.
_FEW_FIT = (
    "SELECT query_id, candidate_id, my, ma, mb, CASE WHEN la THEN cay / va ELSE 0 END AS s, "
    "CASE WHEN NOT la THEN 0 WHEN NOT lb THEN cay / va WHEN va * vb - cab ** 2 <= 1e-9 * va * vb THEN cay / va / 2 "
    "ELSE (cay * vb - cby * cab) / (va * vb - cab ** 2) END AS ba, "
    "CASE WHEN NOT lb THEN 0 WHEN NOT la THEN cby / vb WHEN va * vb - cab ** 2 <= 1e-9 * va * vb THEN cby / vb / 2 "
    "ELSE (cby * va - cay * cab) / (va * vb - cab ** 2) END AS bb FROM (SELECT *, va > 1e-18 * qa AS la, vb > 1e-18 * qb AS lb FROM "
    "(SELECT query_id, candidate_id, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, avg(a * a) AS qa, "
    "avg(b * b) AS qb, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM xy WHERE tr GROUP BY ALL))")
_U12 = (
    "truth AS (SELECT query_id, candidate_id, " + rs("(n.r2 - p.r2) / abs(nullif(p.r2, 0))", 9) + " AS gain "
    f"FROM ({_BEFORE}) p JOIN ({_AFTER}) n USING (query_id, candidate_id)), ").replace("/ var_pop(y)", "/ nullif(var_pop(y), 0)") + (
    "base_keys AS (SELECT DISTINCT dataset_id, row_key FROM cells), "
    "met AS (SELECT query_id, candidate_id, count(k.row_key)::DOUBLE / count(*) AS containment FROM pairs JOIN base_keys q ON q.dataset_id = query_id "
    "LEFT JOIN base_keys k ON k.dataset_id = candidate_id AND k.row_key = q.row_key GROUP BY 1, 2), "
    "s AS (SELECT CASE WHEN gain > 0 THEN 'gain' ELSE 'loss' END AS class, CASE WHEN containment >= 0.6 THEN 'gain' ELSE 'loss' END AS pred_class "
    "FROM truth JOIN met USING (query_id, candidate_id)), ")


@query("u12_candidates_by_true_gain", with_tables(
    "", cells=lake.nation_cells_sql(), pairs=lake.NATION_PAIRS_SQL, rows=ALIGNED, xy=_XY, fit=_FEW_FIT).rstrip() + ", " + _U12 + report_sql())
def true_gain(spark, sf):
    """Label every candidate by the gain of joining it alone and report on a containment rule; what rounding leaves is no gain."""
    cells = materialise(lake.nation_cells(spark, sf))
    pairs = materialise(lake.nation_pairs(cells))
    truth = scores.relative_targets(scores.before_and_after(pairs, cells))
    truth = truth.withColumn("gain_in_r2_score", rnd("gain_in_r2_score", 9))
    known = labels.by_threshold(truth, gain="gain_in_r2_score", out="class")
    ranked = prune.ranked_by_containment(pairs, cells).withColumn(
        "pred_class", labels.label(F.col("containment") >= 0.6))
    out = classification_report(known.join(ranked, PAIR), "class", "pred_class")
    return out.withColumns({c: rnd(c, 8) for c in ("precision", "recall", "f1")})


# ---- selectors -----------------------------------------------------------------------------------

LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey", "noise"]


def _table(spark, sf):
    """A wide table: the price of a line and what might explain it."""
    li = lake.table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.groupBy(key.alias("row_key"), "l_linenumber", "l_partkey", "l_suppkey").agg(
        F.max("l_extendedprice").alias("l_extendedprice"), F.max("l_quantity").alias("l_quantity"),
        F.max("l_discount").alias("l_discount"), F.max("l_tax").alias("l_tax"),
        F.max(F.col("l_orderkey") % 97).alias("noise"))


_LINES_SQL = (
    "SELECT y, unnest([" + ", ".join(f"'{f}'" for f in LINE_FEATURES) + "]) AS col, unnest([q, d, t, l_linenumber, l_partkey, l_suppkey, z]"
    "::DOUBLE[]) AS x FROM (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k, l_linenumber, l_partkey, "
    "l_suppkey, max(l_extendedprice) AS y, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t, max(l_orderkey % 97) AS z "
    "FROM lineitem GROUP BY ALL)")
_ROOT = ("SELECT col, {v} AS {n}, rank FROM (SELECT *, row_number() OVER (ORDER BY s DESC, col) AS rank, count(*) OVER () AS p FROM "
         "({f})) WHERE rank <= floor(sqrt(p))")


def _tall(spark, sf):
    return select.unpivot(_table(spark, sf), "row_key", "l_extendedprice", LINE_FEATURES)


@query("k07_f_test", with_tables(_ROOT.format(
    v=rs("s", 3), n="f", f="SELECT col, corr(x, y) ** 2 / (1 - corr(x, y) ** 2) * (count(*) - 2) AS s FROM t GROUP BY 1").replace(
    "AS rank,", "::INTEGER AS rank,"), t=_LINES_SQL))
def f_test(spark, sf):
    return select.by_f_test(_tall(spark, sf)).withColumn("f", rnd("f", 3))


@query("k08_correlation", with_tables(_ROOT.format(
    v=rs("s", 7), n="r", f="SELECT col, abs(corr(x, y)) AS s FROM t GROUP BY 1").replace("AS rank,", "::INTEGER AS rank,"), t=_LINES_SQL))
def correlation(spark, sf):
    return select.by_correlation(_tall(spark, sf)).withColumn("r", rnd("r", 7))


def _bin(v):
    return (f"floor((rank() OVER (PARTITION BY col ORDER BY {v}) + (count(*) OVER (PARTITION BY col, {v}) - 1) / 2.0::DOUBLE - 0.5::DOUBLE) * 32 / "
            "count(*) OVER (PARTITION BY col))")


@query("k09_mutual_information", with_tables(
    f"SELECT col, {rs('sum(c / n * ln(c * n / (cx * cy)))', 7)} AS mutual_info FROM (SELECT *, sum(c) OVER (PARTITION BY col) AS n, "
    "sum(c) OVER (PARTITION BY col, bx) AS cx, sum(c) OVER (PARTITION BY col, by_) AS cy FROM (SELECT col, bx, by_, count(*)::DOUBLE AS c FROM "
    f"(SELECT col, {_bin('x')} AS bx, {_bin('y')} AS by_ FROM t) GROUP BY ALL)) GROUP BY 1", t=_LINES_SQL))
def mutual(spark, sf):
    return select.mutual_information(_tall(spark, sf)).withColumn("mutual_info", rnd("mutual_info", 7))


@query("k12_low_variance", with_tables(
    f"SELECT col, {rs('var_pop(x)', 9)} AS variance FROM t GROUP BY 1 HAVING var_pop(x) <= 0.01", t=_LINES_SQL))
def variance(spark, sf):
    return select.low_variance(_tall(spark, sf)).withColumn("variance", rnd("variance", 9))


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "col string")


_WIDE_SQL = ("SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_key, l_linenumber, l_partkey, l_suppkey, "
             "max(l_extendedprice) AS y, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_tax) AS l_tax, "
             "max(l_orderkey % 97) AS noise FROM lineitem GROUP BY ALL")
_DOUBLED = [*LINE_FEATURES, "double_quantity"]


@query("k13_correlated_features", with_tables(
    " UNION ".join(f"SELECT '{b}' AS col FROM w HAVING abs(corr({a}, {b})) > 0.85" for i, b in enumerate(_DOUBLED) for a in _DOUBLED[:i]),
    w=f"SELECT *, l_quantity * 2 + l_tax AS double_quantity FROM ({_WIDE_SQL})"))
def correlated(spark, sf):
    t = _table(spark, sf).withColumn("double_quantity", F.col("l_quantity") * 2 + F.col("l_tax"))
    return _names(spark, select.correlated(t, [*LINE_FEATURES, "double_quantity"]))


def _random_sql():
    p = len(LINE_FEATURES)
    columns = [" + ".join(f"({f} - m) * {float(z)!r}::DOUBLE" for f, z in zip(LINE_FEATURES, row))
               for row in select.mixing_weights(p)]
    return with_tables("SELECT row_key, " + ", ".join(
        rs(f"m + ({c}) / sqrt({p - 1}.0::DOUBLE)", 4) + f" AS {select.RANDOM_PREFIX}{i}" for i, c in enumerate(columns)) + " FROM w",
        w="SELECT *, (" + " + ".join(f"{f}::DOUBLE" for f in LINE_FEATURES) + f") / {p} AS m FROM ({_WIDE_SQL})")


@query("k01_random_features", _random_sql())
def random_features(spark, sf):
    out, names = select.add_random_features(_table(spark, sf), LINE_FEATURES)
    return out.select("row_key", *[rnd(n, 4).alias(n) for n in names])


_COEFS_SQL = ("SELECT p_size AS ranking, p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'random_feature_' ELSE 'f_' END || p_partkey AS col, "
              "(p_partkey % 17) / 170.0::DOUBLE AS rf, (p_partkey % 13) - 6.0::DOUBLE AS lasso FROM part")


def _coefs(spark, sf):
    k = F.col("p_partkey")
    return lake.table(spark, sf, "part").select(
        F.col("p_size").alias("ranking"),
        F.concat(F.when(k % 4 == 0, "random_feature_").otherwise("f_"), k.cast("string")).alias("col"),
        (k % 17 / 170.0).alias("rf"), (k % 13 - 6.0).alias("lasso"))


_RANKING_SQL = (f"SELECT ranking, col, score, row_number() OVER (PARTITION BY ranking ORDER BY score DESC, col)::INTEGER AS rank FROM (SELECT *, "
                f"0.5 * rf + 0.5 * coalesce(s / nullif(sum(s) OVER (PARTITION BY ranking), 0), 0) AS score FROM (SELECT *, lasso - min(lasso) OVER "
                f"(PARTITION BY ranking) AS s FROM ({_COEFS_SQL})))")


@query("k02_combined_rankings", f"SELECT ranking, col, {rs('score', 9)} AS score, rank FROM ({_RANKING_SQL})")
def combined(spark, sf):
    return select.combined_ranking(_coefs(spark, sf)).select("ranking", "col", rnd("score", 9).alias("score"), "rank")


@query("k03_injection_quality",
       "SELECT col, " + rs("avg((rank < coalesce(fr, 2147483648))::INTEGER)", 9)
       + f" AS quality FROM ({_RANKING_SQL}) JOIN (SELECT ranking, min(rank) FILTER (col LIKE 'random%') AS fr FROM ({_RANKING_SQL}) GROUP BY 1) "
         "USING (ranking) WHERE col NOT LIKE 'random%' GROUP BY 1")
def quality(spark, sf):
    return select.injection_quality(select.combined_ranking(_coefs(spark, sf))).withColumn("quality", rnd("quality", 9))


@query("k04_injection_rankings")
def injection(spark, sf):
    return select.injection_rankings(_table(spark, sf), "row_key", "l_extendedprice", LINE_FEATURES)


@query("k05_random_injection")
def random_injection(spark, sf):
    return _names(spark, select.random_injection(_table(spark, sf), "row_key", "l_extendedprice", LINE_FEATURES, keep="best"))


@query("k06_recursive_elimination")
def elimination(spark, sf):
    return _names(spark, select.recursive_elimination(_table(spark, sf), "l_extendedprice", LINE_FEATURES))


@query("k10_shadow_selection")
def shadows(spark, sf):
    found = select.shadow_selection(_table(spark, sf), "row_key", "l_extendedprice", LINE_FEATURES)
    return spark.createDataFrame(list(found.items()), "col string, verdict string")


@query("k11_forward_stepwise")
def stepwise(spark, sf):
    return _names(spark, select.forward_stepwise(_table(spark, sf), "row_key", "l_extendedprice", LINE_FEATURES))


@query("k14_k15_score_and_overlap")
def score_overlap(spark, sf):
    t = _table(spark, sf)
    chosen = select.recursive_elimination(t, "l_extendedprice", LINE_FEATURES)
    r2 = select.score_columns(t, "row_key", "l_extendedprice", chosen)
    useful = [r["col"] for r in select.by_correlation(_tall(spark, sf)).collect()]
    return spark.createDataFrame([(float(r2), select.selection_overlap(chosen, useful))],
                                 "r2 double, overlap double")


@query("k15_selection_overlap", with_tables(
    "SELECT count(b.col) / count(*)::DOUBLE AS overlap FROM a LEFT JOIN b USING (col)",
    t=_LINES_SQL,
    a="SELECT col FROM (SELECT col, row_number() OVER (ORDER BY var_pop(x) DESC, col) AS k, count(*) OVER () AS p FROM t GROUP BY 1) WHERE k <= floor(sqrt(p))",
    b="SELECT col FROM (SELECT col, row_number() OVER (ORDER BY abs(corr(x, y)) DESC, col) AS k, count(*) OVER () AS p FROM t GROUP BY 1) WHERE k <= floor(sqrt(p))"))
def overlap(spark, sf):
    """How many of the features of largest variance are among the best by correlation."""
    tall = _tall(spark, sf)
    widest = select.keep_top_root(select.low_variance(tall, float("inf")), "variance")
    share = select.selection_overlap([r["col"] for r in widest.collect()],     # names of features only
                                     [r["col"] for r in select.by_correlation(tall).collect()])
    return spark.createDataFrame([(share,)], "overlap double")
