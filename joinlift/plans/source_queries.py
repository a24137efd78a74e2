"""Ingest, files, identity and clean-up, on data derived from the given tables."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinlift.functions import positions, shared_dir
from joinlift.operators import joins, profile, report
from joinlift.plans import testlake as lake
from joinlift.plans.registry import query, with_tables
from joinlift.schema import ALL_FEATURES, PAIR, RELATIVE_TARGETS
from joinlift.sources import lake as src


def _fresh(spark) -> str:
    return f"{shared_dir(spark)}/joinlift-{uuid.uuid4().hex}"


# ---- bundles: every brand is a dataset, its parts decide the documents --------------------------

def _docs(spark, sf):
    part = lake.table(spark, sf, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.max("p_size").alias("size"), F.min("p_partkey").alias("k"))
    table_cols = [("id", "integer"), ("size", "real"), ("price", "real"), ("kind", "categorical")]
    columns = F.array(*[F.struct(F.lit(i).alias("colIndex"), F.lit(n).alias("colName"),
                                 F.array(F.lit(t)).alias("colType"))
                        for i, (n, t) in enumerate(table_cols)])
    doc = F.to_json(F.struct(F.array(F.struct(
        F.lit("learningData").alias("resID"), F.lit("tables/learningData.csv").alias("resPath"),
        columns.alias("columns"))).alias("dataResources")))
    problem = F.to_json(F.struct(
        F.struct(F.when(F.col("k") % 3 == 0, "classification").otherwise("regression").alias("taskType"))
        .alias("about"),
        F.struct(F.array(F.struct(F.array(F.struct(
            F.when(F.col("k") % 5 == 0, 3).otherwise(2).alias("colIndex"), F.lit("t").alias("colName")))
            .alias("targets"))).alias("data")).alias("inputs")))
    return part.select(F.col("p_brand").alias("dataset_id"), "n", "k", doc.alias("doc"),
                       problem.alias("problem"))


_BRANDS = "SELECT p_brand AS dataset_id, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1"


@query("s03_column_metadata", with_tables(
    "SELECT dataset_id, i::INTEGER AS col_index, col, t AS col_type, (CASE WHEN k % 5 = 0 THEN 3 ELSE 2 END)::INTEGER AS target_index, "
    "CASE WHEN k % 3 = 0 THEN 'classification' ELSE 'regression' END AS task_type FROM b, (VALUES (0, 'id', 'integer'), (1, 'size', 'real'), "
    "(2, 'price', 'real'), (3, 'kind', 'categorical')) t(i, col, t)", b=_BRANDS))
def column_metadata(spark, sf):
    docs = _docs(spark, sf)
    meta = src.parse_columns(docs.select("dataset_id", "doc"))
    problem = src.parse_problems(docs.select("dataset_id", F.col("problem").alias("doc")))
    return meta.join(problem, "dataset_id").select(
        "dataset_id", "col_index", "col", F.get("col_type", F.lit(0)).alias("col_type"),
        "target_index", "task_type")


@query("s01_s02_validity_gate", with_tables(
    "SELECT dataset_id, CASE WHEN k % 7 = 1 THEN 'missing files' WHEN k % 3 = 0 THEN 'not a regression' WHEN k % 5 = 0 THEN "
    "'target not numeric' WHEN n < (SELECT avg(n) FROM b) THEN 'too few rows' ELSE 'accepted' END AS reject_reason FROM b", b=_BRANDS))
def gate(spark, sf):
    docs = _docs(spark, sf)
    names = F.array(F.lit("learningData.csv"), F.lit("datasetDoc.json"), F.lit("problemDoc.json"))
    files = docs.select("dataset_id", F.explode(F.when(
        F.col("k") % 7 == 1, F.slice(names, 1, 2)).otherwise(names)).alias("file"))
    meta = src.parse_columns(docs.select("dataset_id", "doc"))
    problem = src.parse_problems(docs.select("dataset_id", F.col("problem").alias("doc")))
    counts = docs.select("dataset_id", F.col("n").alias("n_rows"))
    least = docs.agg(F.avg("n").alias("a")).first()["a"]
    gated = src.gate(files, meta, problem, counts, min_rows=least, max_columns=30)
    return gated.withColumn("reject_reason", F.coalesce("reject_reason", F.lit("accepted")))


@query("s04_candidate_folder", lake.single_cells_sql("cust_orders", "user_events")
       .replace("dataset_id || '/' || col AS", "dataset_id || '.' || col AS"))
def candidate_folder(spark, sf):
    """Write every candidate column to a folder of its own, read all back as cells."""
    path = _fresh(spark)
    cells = lake.cells(spark, sf, "cust_orders", "user_events")
    for name in cells.select("col").distinct().collect():   # column names of two tables
        one = cells.where(F.col("col") == name["col"])
        one.select(F.concat_ws(".", "dataset_id", "col").alias("name"), F.col("row_key").alias("key"),
                   F.col("v").alias(name["col"])).write.mode("append").partitionBy("name").csv(
            path, header=True)
    return src.read_candidates(spark, path, "key", named_by="folder")


# ---- bundles as files: a dataset per brand, each with its own fault, and one large table -----------

_FAULTS = ["accepted", "missing files", "not a regression", "several tables", "target not numeric", "too few columns", "unreadable", "too few rows",
           "too many rows"]
_MIN_ROWS, _REPEATS = 3, 20


def _bundles(spark, sf, with_lines):
    """Writes the bundles, with the large table or with brands repeated until they are too large; gives their folder and the limit of rows."""
    part = lake.table(spark, sf, "part").withColumn("b", F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int"))
    fault = F.element_at(F.array(*[F.lit(f) for f in _FAULTS]), F.col("b") % len(_FAULTS) + 1)
    part = part.withColumn("fault", fault).withColumn("dataset_id", F.concat(F.lit("brand "), "b"))
    quoted = F.concat(F.lit('"'), "p_name", F.lit('\n, a ""second"" line\n"'))
    line = F.concat_ws(",", "p_partkey", quoted, "p_size", "p_retailprice")
    order = F.row_number().over(Window.partitionBy("dataset_id").orderBy("p_partkey"))       # a brand's parts
    rows = part.select("dataset_id", "fault", order.alias("n"), line.alias("line"))
    rows = rows.where("fault <> 'too few rows' or n < 3").withColumn(
        "line", F.when((F.col("fault") == "unreadable") & (F.col("n") == 1), F.concat("line", F.lit(',"open'))).otherwise(F.col("line")))
    copies = F.explode(F.sequence(F.lit(0), F.when((F.col("fault") == "too many rows") & F.lit(not with_lines), _REPEATS - 1).otherwise(0)))
    rows = rows.select("dataset_id", "n", copies.alias("copy"), "line").select(
        "dataset_id", (F.col("n") + F.col("copy").cast("long") * 1_000_000_000).alias("row_ord"), "line")
    lines = positions(lake.table(spark, sf, "lineitem"), [], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select(
        F.lit("lines").alias("dataset_id"), (F.col("pos") + 1).alias("row_ord"),
        F.concat_ws(",", "l_linenumber", F.concat(F.lit('"'), "l_returnflag", F.lit('\n"')), "l_quantity", "l_extendedprice").alias("line"))
    lines = lines.where(F.lit(with_lines))
    heads = rows.unionByName(lines).select("dataset_id").distinct().select(
        "dataset_id", F.lit(0).cast("long").alias("row_ord"), F.lit("id,kind,size,price").alias("line"))
    kinds = part.select("dataset_id", "fault").unionByName(lines.select("dataset_id", F.lit("accepted").alias("fault"))).distinct()

    def column(i, name, kind):
        return F.struct(F.lit(i).alias("colIndex"), F.lit(name).alias("colName"), F.array(kind if not isinstance(kind, str) else F.lit(kind)).alias("colType"))
    few = F.when(F.col("fault") == "too few columns", "categorical").otherwise("real")
    table = F.struct(F.lit("learningData").alias("resID"), F.lit("tables/learningData.csv").alias("resPath"), F.array(
        column(0, "id", "integer"), column(1, "kind", "categorical"), column(2, "size", few), column(3, "price", "real")).alias("columns"))
    doc = F.to_json(F.struct(F.when(F.col("fault") == "several tables", F.array(table, table)).otherwise(F.array(table)).alias("dataResources")))
    target = F.when(F.col("fault") == "target not numeric", 1).otherwise(3).alias("colIndex")
    problem = F.to_json(F.struct(
        F.struct(F.when(F.col("fault") == "not a regression", "classification").otherwise("regression").alias("taskType")).alias("about"),
        F.struct(F.array(F.struct(F.array(F.struct(target, F.lit("t").alias("colName"))).alias("targets"))).alias("data")).alias("inputs")))
    docs = kinds.select("dataset_id", doc.alias("doc"), F.when(F.col("fault") != "missing files", problem).alias("problem"))
    path = _fresh(spark)
    src.write_bundles(rows.unionByName(lines).unionByName(heads), docs, path)
    sizes = part.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    return path, lake.table(spark, sf, "lineitem").count() if with_lines else 2 * sizes.first()["n"]


_FAULT_SQL = ("[" + ", ".join(f"'{f}'" for f in _FAULTS) + f"][b % {len(_FAULTS)} + 1]")
_BUNDLES_SQL = dict(
    p="SELECT *, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS b FROM part",
    f=f"SELECT 'brand ' || b AS dataset_id, {_FAULT_SQL} AS fault, p_partkey, p_size, p_retailprice, "
      "row_number() OVER (PARTITION BY b ORDER BY p_partkey) AS n FROM p")


@query("s01_bundle_cells", with_tables(
    "SELECT dataset_id, row_ord, col, v FROM (SELECT f.dataset_id, n AS row_ord, unnest(['id', 'size', 'price']) AS col, "
    "unnest([p_partkey::DOUBLE, p_size::DOUBLE, p_retailprice::DOUBLE]) AS v FROM f JOIN g USING (dataset_id) WHERE fault IN ('accepted', 'too many rows') AND total >= 3) "
    "UNION ALL SELECT 'lines', row_ord, unnest(['id', 'size', 'price']), unnest([l_linenumber::DOUBLE, l_quantity::DOUBLE, l_extendedprice::DOUBLE]) "
    "FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS row_ord FROM lineitem)",
    **_BUNDLES_SQL, g="SELECT dataset_id, count(*) AS total FROM f GROUP BY 1"))
def bundle_cells(spark, sf):
    """Bundles written from parts and lines, with quoted line breaks, and read back: the cells of those that the gate lets through."""
    path, most = _bundles(spark, sf, True)
    found, counts = src.table_records(spark, path)
    gated = _gated(spark, path, counts, most)
    cells, _ = src.read_bundle(spark, path, found=found)
    return cells.join(gated.where("reject_reason is null"), "dataset_id", "left_semi").select("dataset_id", "row_ord", "col", "v")


def _gated(spark, path, counts, most):
    return src.gate(src.bundle_files(spark, path), src.columns_meta(spark, path), src.problems(spark, path), counts,
                    min_rows=_MIN_ROWS, max_columns=30, max_rows=most)


@query("s02_gate_of_bundles", with_tables(
    "SELECT dataset_id, CASE WHEN fault = 'accepted' OR fault = 'too many rows' AND total * 20 <= 2 * (SELECT max(total) FROM g) THEN "
    "CASE WHEN total < 3 AND fault = 'accepted' OR total * 20 < 3 THEN 'too few rows' ELSE 'accepted' END ELSE fault END AS reject_reason "
    "FROM (SELECT DISTINCT dataset_id, fault FROM f) JOIN g USING (dataset_id)",
    **_BUNDLES_SQL, g="SELECT dataset_id, count(*) AS total FROM f GROUP BY 1"))
def bundle_gate(spark, sf):
    """The gate on the same files; every reason occurs."""
    path, most = _bundles(spark, sf, False)
    _, counts = src.table_records(spark, path)
    return _gated(spark, path, counts, most).withColumn("reject_reason", F.coalesce("reject_reason", F.lit("accepted")))


# ---- a folder of a thousand layouts, and a key name for each candidate -----------------------------

_LAYOUTS = 1000


def _layouts(spark, sf):
    """A file per value of ``l_partkey % 1000``, each with a header of its own; some have no key column, some quotes that do not close."""
    path = _fresh(spark)
    k = F.col("l_partkey") % _LAYOUTS
    rows = lake.table(spark, sf, "lineitem").select(k.alias("k"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), "l_quantity", "l_extendedprice")
    even = F.col("k") % 2 == 0
    line = F.when(even, F.concat_ws(",", "key", "l_quantity", "l_extendedprice")).otherwise(F.concat_ws(",", "l_quantity", F.concat(
        F.lit('"'), "key", F.lit('"')), "l_extendedprice"))
    body = rows.select("k", F.lit(1).alias("o"), line.alias("line"))
    name = F.when(F.col("k") % 100 == 7, "other").otherwise("key")
    v, w = F.concat(F.lit("v"), "k"), F.concat(F.lit("w"), "k")
    head = rows.select("k").distinct().select("k", F.lit(0).alias("o"), F.when(even, F.concat_ws(",", name, v, w)).otherwise(
        F.concat_ws(",", v, name, w)).alias("line"))
    tail = rows.select("k").distinct().where("k % 100 = 9").select("k", F.lit(2).alias("o"), F.lit('1,"open').alias("line"))
    body.unionByName(head).unionByName(tail).withColumn("name", F.concat(F.lit("t"), "k")).repartition("name").sortWithinPartitions("name", "o").select(
        "name", "line").write.partitionBy("name").text(path)
    return path


_LAYOUT_SQL = "SELECT l_partkey % 1000 AS k, l_orderkey || '-' || l_linenumber AS row_key, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p FROM lineitem"


@query("s04_thousand_layouts", with_tables(
    "SELECT 't' || k AS dataset_id, row_key, unnest(['v' || k, 'w' || k]) AS col, unnest([q, p]) AS v FROM t WHERE k % 100 NOT IN (7, 9)", t=_LAYOUT_SQL))
def thousand_layouts(spark, sf):
    """One scan over a thousand headers."""
    return src.read_candidates(spark, _layouts(spark, sf), "key", named_by="folder")


@query("s04_refused_files", with_tables(
    "SELECT DISTINCT 't' || k AS dataset_id, CASE k % 100 WHEN 7 THEN 'no key column' WHEN 9 THEN 'unclosed quote' ELSE 'read' END AS reason FROM t", t=_LAYOUT_SQL))
def refused_files(spark, sf):
    """What became of each of the files."""
    files = src.ingest_candidates(spark, _layouts(spark, sf), "key", named_by="folder")[1]
    return files.select("dataset_id", F.coalesce("reason", F.lit("read")).alias("reason"))


_KEYS = {"cust_orders": "customer no", "user_events": "user"}


@query("j04_key_per_candidate", with_tables(
    "SELECT p.candidate_id, q.row_key, d.col, c.v FROM p JOIN (SELECT DISTINCT row_key FROM cells WHERE dataset_id = 'customer') q ON true "
    "JOIN (SELECT DISTINCT dataset_id, col FROM cells) d ON d.dataset_id = p.candidate_id LEFT JOIN cells c ON c.dataset_id = p.candidate_id "
    "AND c.row_key = q.row_key AND c.col = d.col", p="SELECT unnest(['cust_orders', 'user_events']) AS candidate_id",
    cells=lake.cells_sql("customer", *_KEYS)))
def key_per_candidate(spark, sf):
    """Candidates whose files call the key by different names, joined to one base."""
    path, cells = _fresh(spark), lake.stored_cells(spark, sf, "customer", *_KEYS)
    for name, key in _KEYS.items():
        wide = cells.where(F.col("dataset_id") == name).groupBy("row_key").pivot("col").agg(F.first("v"))
        wide.withColumnRenamed("row_key", key).withColumn("name", F.lit(name)).repartition(2).write.mode("append").partitionBy("name").csv(path, header=True)
    keys = spark.createDataFrame(list(_KEYS.items()), "dataset_id string, key string")
    read = src.read_candidates(spark, path, keys, named_by="folder")
    joined = joins.augmentation_join(lake.pairs(spark, "customer"), cells.where("dataset_id = 'customer'").unionByName(read))
    return joined.where("side = 'candidate'").select("candidate_id", "row_key", "col", "v")


@query("j05_cells_of_pairs", with_tables(
    "SELECT 'query' AS side, p.*, row_key, col, v FROM p JOIN cells ON dataset_id = query_id UNION ALL "
    "SELECT 'candidate', p.*, row_key, col, v FROM p JOIN cells ON dataset_id = candidate_id", p=lake.pairs_sql(), cells=lake.cells_sql()))
def cells_of_pairs(spark, sf):
    """The cells behind both sides of every pair."""
    pairs, cells = lake.pairs(spark), lake.stored_cells(spark, sf)
    return joins.pair_cells(pairs, cells, "query").withColumn("side", F.lit("query")).unionByName(
        joins.pair_cells(pairs, cells, "candidate").withColumn("side", F.lit("candidate"))).select("side", *PAIR, "row_key", "col", "v")


def _records(spark, sf):
    s = lake.instances(spark, sf)
    pairs = {"mean_absolute_error": ("p_gain", "containment"), "mean_squared_error": ("containment", "p_gain"),
             "median_absolute_error": ("price", "price"), "r2_score": ("r2_before", "r2_after")}
    return s.select(
        F.col("query_id").alias("query_dataset"), "target", F.col("candidate_id").alias("candidate_dataset"),
        F.when(F.col("p_gain") > 0.5, "mean").alias("imputation_strategy"),
        F.col("gain_marker").alias("mark"), *[F.array(a, b).alias(n) for n, (a, b) in pairs.items()])


@query("s05_s07_training_records", with_tables(
    "SELECT query_id, candidate_id, target, CASE WHEN p_gain > 0.5 THEN 'mean' END AS imputation_strategy, gain_marker AS mark, "
    "p_gain AS mae_before, containment AS mae_after, r2_before, r2_after FROM t", t=lake.INSTANCES_SQL))
def training_records(spark, sf):
    """Write training records as JSON lines and parse them again."""
    path = _fresh(spark)
    src.write_records(_records(spark, sf), path, "gzip")
    return src.record_pairs(src.read_records(spark, path)).select(
        "query_id", "candidate_id", "target", "imputation_strategy", "mark", "mae_before", "mae_after",
        "r2_before", "r2_after")


@query("s06_s07_learning_instances", with_tables(
    "SELECT query_id AS query, candidate_id AS candidate, containment AS first_feature, 26::INTEGER AS n_features, "
    "gain AS gain_in_r2_score FROM t", t=lake.INSTANCES_SQL))
def learning_instances(spark, sf):
    """Write learning instances as quoted CSV and split them into ids, features and targets."""
    path = _fresh(spark)
    s = lake.instances(spark, sf)
    wide = s.select(F.col("query_id").alias("query"), "target", F.col("candidate_id").alias("candidate"),
                    *[F.col("containment").alias(f) for f in ALL_FEATURES],
                    *[F.col("gain").alias(t) for t in RELATIVE_TARGETS])
    src.write_instances(wide, path)
    back = src.instance_parts(src.read_instances(spark, path))
    return back.select("query", "candidate", F.get("features", F.lit(0)).alias("first_feature"),
                       F.size("features").alias("n_features"), "gain_in_r2_score")


@query("s08_resume_stage", with_tables("SELECT count(*) AS n, count(DISTINCT query_id) AS q, 1::INTEGER AS times_made FROM s", s=lake.SCORED_SQL))
def resume(spark, sf):
    """A stage asked for twice is made once."""
    path, made = _fresh(spark), []

    def make():
        made.append(1)
        return lake.scored(spark, sf)
    src.stage(spark, path, make)
    again = src.stage(spark, path, make)
    return again.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("q"),
                     F.lit(len(made)).alias("times_made"))


_COPIES = (
    "SELECT dataset_id, row_key, col, v FROM cells UNION ALL SELECT dataset_id || '_copy', row_key, col, v FROM cells "
    "UNION ALL SELECT dataset_id || '_changed', row_key, col, v + 1 FROM cells")


@query("s09_content_ids", with_tables(
    "SELECT dataset_id, min(dataset_id) OVER (PARTITION BY c) AS same_as FROM (SELECT dataset_id, md5(string_agg(row_key || '|' || col || '|' || v, ',' "
    f"ORDER BY row_key, col)) AS c FROM ({_COPIES}) GROUP BY 1)", cells=lake.cells_sql("customer", "cust_orders", "order_days")))
def content_ids(spark, sf):
    cells = lake.cells(spark, sf, "customer", "cust_orders", "order_days")
    copies = cells.unionByName(cells.withColumn("dataset_id", F.concat("dataset_id", F.lit("_copy")))).unionByName(
        cells.withColumn("dataset_id", F.concat("dataset_id", F.lit("_changed"))).withColumn("v", F.col("v") + 1))
    ids = src.content_ids(copies)
    first = ids.groupBy("content_id").agg(F.min("dataset_id").alias("same_as"))
    return ids.join(first, "content_id").select("dataset_id", "same_as")


@query("s10_flatten_to_cells",
       "SELECT dataset_id, row_key, col, TRY_CAST(v AS DOUBLE) AS v FROM (SELECT 'customer' AS dataset_id, c_custkey::VARCHAR AS row_key, "
       "unnest(['c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS col, "
       "unnest([c_name, c_nationkey::VARCHAR, c_acctbal::VARCHAR, c_mktsegment]) AS v FROM customer)")
def flatten(spark, sf):
    return src.to_cells(lake.table(spark, sf, "customer"), "c_custkey", "customer")


@query("s11_drop_empty_columns",
       "SELECT dataset_id, row_key, col, v FROM (SELECT 'customer' AS dataset_id, c_custkey::VARCHAR AS row_key, "
       "unnest(['c_nationkey', 'c_acctbal']) AS col, unnest([c_nationkey::DOUBLE, c_acctbal]) AS v FROM customer)")
def drop_empty(spark, sf):
    return src.drop_empty(src.to_cells(lake.table(spark, sf, "customer"), "c_custkey", "customer"))


@query("s11_numeric_columns", with_tables(
    "SELECT dataset_id, row_key, col, v FROM cells WHERE col IN ('n_orders', 'n_events')", cells=lake.cells_sql("cust_orders", "user_events")))
def numeric_columns(spark, sf):
    cells = lake.cells(spark, sf, "cust_orders", "user_events")
    meta = cells.select("dataset_id", "col").distinct().withColumn("col_type", F.array(F.when(
        F.col("col").isin("n_orders", "n_events"), "integer").otherwise("categorical")))
    return src.numeric_columns(cells, meta)


@query("s12_drop_repeated_names", with_tables(
    "SELECT dataset_id, row_key, col, v FROM cells WHERE dataset_id <> 'order_days' AND regexp_replace(lower(trim(col)), '[-_\\s]', '-', 'g') NOT IN "
    "(SELECT regexp_replace(lower(trim(name)), '[-_\\s]', '-', 'g') FROM base)",
    cells=lake.cells_sql(), base="SELECT DISTINCT upper(replace(col, '_', ' ')) AS name FROM cells WHERE dataset_id = 'order_days'"))
def repeated_names(spark, sf):
    """Every other dataset of the lake against a base whose names are written in another way."""
    cells = lake.stored_cells(spark, sf)
    base = cells.where("dataset_id = 'order_days'").withColumn("col", F.upper(F.translate("col", "_", " ")))
    return src.drop_repeated_names(cells.where("dataset_id <> 'order_days'"), base)


_BYTES = "SELECT source AS dataset_id, count(*) AS n_lines, (sum(strlen(text) + 1))::BIGINT AS n_bytes FROM documents GROUP BY 1"


def _sizes(spark, sf):
    docs = lake.table(spark, sf, "documents").select(F.col("source").alias("dataset_id"), F.col("text").alias("line"))
    return profile.source_sizes(docs)


query("a14_source_sizes", _BYTES)(_sizes)


@query("s13_small_datasets", f"SELECT * FROM ({_BYTES}) WHERE n_bytes < (SELECT avg(n_bytes) FROM ({_BYTES}))")
def small(spark, sf):
    sizes = _sizes(spark, sf)
    limit = sizes.agg(F.avg("n_bytes").alias("a")).first()["a"]
    return src.small_enough(sizes, limit)


@query("a12_corpus_statistics", with_tables(
    "SELECT gain_marker AS algorithm, count(*) AS n_records, " + ", ".join(
        f"count(*) FILTER ({b} <= {a}) AS {n}_before_lte_after, count(*) FILTER ({b} > {a}) AS {n}_before_gt_after"
        for n, (b, a) in {"mae": ("p_gain", "containment"), "mse": ("containment", "p_gain"), "medae": ("price", "price"),
                          "r2": ("r2_before", "r2_after")}.items()) + " FROM t GROUP BY 1", t=lake.INSTANCES_SQL))
def corpus(spark, sf):
    return report.corpus_statistics(_records(spark, sf).withColumnRenamed("mark", "algorithm"))


@query("a12_imputation_counts", with_tables(
    "SELECT gain_marker AS algorithm, CASE WHEN p_gain > 0.5 THEN 'mean' ELSE 'none' END AS imputation_strategy, count(*) AS n FROM t GROUP BY 1, 2",
    t=lake.INSTANCES_SQL))
def imputations(spark, sf):
    return report.imputation_counts(_records(spark, sf).withColumnRenamed("mark", "algorithm"))
