"""Joins, association and scores of a base whose key repeats: many orders per customer, told apart by ``row_id``."""

from pyspark.sql import functions as F

from joinlift.operators import assoc, joins, scores
from joinlift.plans import testlake as lake
from joinlift.plans.assoc_queries import GKEY, LINEAR
from joinlift.plans.registry import query, rnd, rnd_sql as rs, with_tables
from joinlift.schema import PAIR

BASE, TARGET = "orders_of", "o_totalprice"
CANDIDATES = ("customer", "cust_orders", "user_events")
_COLUMNS = {"o_totalprice": "o_totalprice", "o_priority": "cast(substr(o_orderpriority, 1, 1) as double)"}

CELLS = (
    " UNION ALL ".join(
        f"SELECT '{BASE}' AS dataset_id, CAST(o_orderkey AS VARCHAR) AS row_id, CAST(o_custkey AS VARCHAR) AS row_key, "
        f"'{c}' AS col, CAST({e} AS DOUBLE) AS v FROM orders" for c, e in _COLUMNS.items())
    + " UNION ALL SELECT dataset_id, row_key AS row_id, row_key, col, v FROM (" + lake.cells_sql(*CANDIDATES) + ")")
PAIRS = " UNION ALL ".join(
    f"SELECT '{BASE}' AS query_id, '{TARGET}' AS target, '{c}' AS candidate_id" for c in CANDIDATES)
_ROWS = f"SELECT DISTINCT row_id, row_key FROM cells WHERE dataset_id = '{BASE}'"
#: Every base row with every column of a candidate; v is null where the key finds nothing.
_MET = (
    "SELECT c.dataset_id AS candidate_id, r.row_id, r.row_key, c.col, k.v FROM "
    f"({_ROWS}) r CROSS JOIN (SELECT DISTINCT dataset_id, col FROM cells WHERE dataset_id <> '{BASE}') c "
    "LEFT JOIN cells k ON k.dataset_id = c.dataset_id AND k.row_key = r.row_key AND k.col = c.col")
_FILLED = ("SELECT candidate_id, row_id, row_key, col, coalesce(v, avg(v) OVER (PARTITION BY candidate_id, col), 0) AS v "
           f"FROM ({_MET})")
_OWN = f"SELECT '{BASE}' AS candidate_id, row_id, row_key, col, v FROM cells WHERE dataset_id = '{BASE}'"
_TARGETS = f"SELECT row_id, v AS y FROM cells WHERE dataset_id = '{BASE}' AND col = '{TARGET}'"


def cells(spark, sf):
    rows = lake.table(spark, sf, "orders").select(
        F.lit(BASE).alias("dataset_id"), F.col("o_orderkey").cast("string").alias("row_id"),
        F.col("o_custkey").cast("string").alias("row_key"),
        *[F.expr(e).cast("double").alias(c) for c, e in _COLUMNS.items()]).unpivot(
        ["dataset_id", "row_id", "row_key"], list(_COLUMNS), "col", "v")
    return rows.unionByName(joins.with_row_id(lake.cells(spark, sf, *CANDIDATES)))


def pairs(spark):
    return spark.createDataFrame([(BASE, TARGET, c) for c in CANDIDATES], "query_id string, target string, candidate_id string")


@query("j01_repeated_base_key", with_tables(
    f"SELECT candidate_id, row_id, row_key, 'candidate' AS side, col, v FROM ({_MET}) UNION ALL "
    f"SELECT p.candidate_id, row_id, row_key, 'query' AS side, col, v FROM ({_OWN}) o CROSS JOIN pairs p",
    cells=CELLS, pairs=PAIRS))
def repeated_join(spark, sf):
    return joins.augmentation_join(pairs(spark), cells(spark, sf)).drop("query_id")


@query("j03_repeated_base_key", with_tables(
    f"SELECT candidate_id, row_id, row_key, col, {rs("v", 8)} AS v FROM ({_FILLED} UNION ALL {_OWN})", cells=CELLS))
def repeated_many_join(spark, sf):
    joined = joins.many_candidate_join(BASE, pairs(spark).select("candidate_id"), cells(spark, sf))
    return joined.withColumn("v", rnd("v", 8))


@query("j03_repeated_base_key_wide", with_tables(
    "SELECT row_id, row_key, " + ", ".join(
        f"{rs(f'max(v) FILTER (candidate_id = {d!r} AND col = {c!r})', 5)} AS {d}_{c}"
        for d, c in ((BASE, TARGET), ("customer", "c_acctbal"), ("cust_orders", "n_orders")))
    + f" FROM ({_FILLED} UNION ALL {_OWN}) GROUP BY 1, 2", cells=CELLS))
def repeated_wide(spark, sf):
    names = [f"{BASE}_{TARGET}", "customer_c_acctbal", "cust_orders_n_orders"]
    joined = joins.many_candidate_join(BASE, pairs(spark).select("candidate_id"), cells(spark, sf)).withColumn(
        "name", F.concat_ws("_", "candidate_id", "col"))
    wide = joins.to_wide(joined.where(F.col("name").isin(names)), names)
    return wide.select("row_id", "row_key", *[rnd(n, 5).alias(n) for n in names])


@query("c01_repeated_base_key", with_tables(
    f"SELECT {GKEY}, {rs('pearson', 6)} AS pearson FROM ({LINEAR})", cells=CELLS,
    rows=f"SELECT '{BASE}' AS query_id, '{TARGET}' AS target, candidate_id, col, v AS x, y FROM ({_FILLED}) JOIN "
         f"({_TARGETS}) USING (row_id)"))
def repeated_pearson(spark, sf):
    return assoc.linear(assoc.aligned(pairs(spark), cells(spark, sf))).select(
        *PAIR, "col", rnd("pearson", 6).alias("pearson"))


@query("c11_repeated_base_key", with_tables(
    f"SELECT {GKEY}, {rs('pearson', 6)} AS pearson FROM ({LINEAR})", cells=CELLS,
    rows=f"SELECT '{BASE}' AS query_id, '{TARGET}' AS target, '{BASE}' AS candidate_id, col, v AS x, y FROM "
         f"({_OWN}) JOIN ({_TARGETS}) USING (row_id) WHERE col <> '{TARGET}'"))
def repeated_own_pearson(spark, sf):
    own = assoc.own_pairs(pairs(spark))
    return assoc.linear(assoc.aligned(own, cells(spark, sf), impute=None)).select(
        *PAIR, "col", rnd("pearson", 6).alias("pearson"))


@query("m01_repeated_base_key_rows", with_tables(
    f"SELECT candidate_id, row_id, y, o.v AS q0, {rs("f.v", 8)} AS c0 FROM ({_FILLED}) f JOIN ({_TARGETS}) USING (row_id) "
    f"JOIN (SELECT row_id, v FROM cells WHERE dataset_id = '{BASE}' AND col = 'o_priority') o USING (row_id) "
    "WHERE f.col IN ('avg_price', 'c_acctbal', 'max_value')", cells=CELLS))
def repeated_model_rows(spark, sf):
    rows = scores.model_rows(pairs(spark), cells(spark, sf))
    return rows.select("candidate_id", "row_id", "y", F.col("qx")[0].alias("q0"), F.col("cx")[0].alias("c0")).withColumn(
        "c0", rnd("c0", 8))
