"""The given tables seen as a lake: bases to be predicted and candidates to join to them.

Every sum of floats is rounded here, so that any engine that reads the
same tables holds bit-identical cells. ``*_SQL`` are the same tables for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlift.functions import materialise

QUERIES = [   # (query dataset, target column)
    ("customer", "c_acctbal"), ("orders", "o_totalprice"), ("order_days", "n_orders")]
PAIRS = [
    ("customer", "c_acctbal", "cust_orders"), ("customer", "c_acctbal", "user_events"),
    ("orders", "o_totalprice", "order_lines"),
    ("order_days", "n_orders", "ship_days"), ("order_days", "n_orders", "event_days")]


# numeric columns of the source tables, in SQL that both engines read
SOURCE_COLUMNS = {
    "lineitem": {c: c for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")},
    "part": {"p_size": "p_size", "p_retailprice": "p_retailprice",
             "brand": "cast(replace(p_brand, 'Brand#', '') as double)"},
    "customer": {"c_nationkey": "c_nationkey", "c_acctbal": "c_acctbal",
                 "segment": "ascii(c_mktsegment)"},
    "supplier": {"s_nationkey": "s_nationkey", "s_acctbal": "s_acctbal"},
}
SOURCE_TARGETS = {"lineitem": "l_extendedprice", "part": "p_retailprice",
                  "customer": "c_acctbal", "supplier": "s_acctbal"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _melt(df: DataFrame, dataset: str, key: Column, columns: dict[str, Column]) -> DataFrame:
    """One dataset of the lake: key and values to cells."""
    wide = df.select(key.cast("string").alias("row_key"),
                     *[c.cast("double").alias(n) for n, c in columns.items()])
    return wide.unpivot(["row_key"], list(columns), "col", "v").select(
        F.lit(dataset).alias("dataset_id"), "row_key", "col", "v")


def _by(df: DataFrame, key: Column, aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(key.alias("__k")).agg(*[a.alias(n) for n, a in aggs.items()])


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The datasets of the lake by name, each as cells."""
    def t(n):
        return table(spark, sf_dir, n)
    orders, lines, events = t("orders"), t("lineitem"), t("events")

    def agg(name, df, key, aggs):
        return _melt(_by(df, key, aggs), name, F.col("__k"), {n: F.col(n) for n in aggs})
    n = F.count(F.lit(1))
    return {
        "customer": _melt(t("customer"), "customer", F.col("c_custkey"), {
            "c_acctbal": F.col("c_acctbal"), "c_nationkey": F.col("c_nationkey")}),
        "orders": _melt(orders, "orders", F.col("o_orderkey"), {
            "o_totalprice": F.col("o_totalprice"),
            "o_priority": F.substring("o_orderpriority", 1, 1).cast("double")}),
        "order_days": agg("order_days", orders, _day("o_orderdate"), {
            "n_orders": n, "max_price": F.max("o_totalprice"),
            "n_urgent": F.count_if(F.col("o_orderpriority") == "1-URGENT")}),
        "cust_orders": agg("cust_orders", orders, F.col("o_custkey"), {
            "n_orders": n, "sum_price": F.round(F.sum("o_totalprice"), 2),
            "max_price": F.max("o_totalprice"), "avg_price": F.round(F.sum("o_totalprice"), 2) / n}),
        "user_events": agg("user_events", events, F.col("user_id"), {
            "n_events": n, "sum_value": F.round(F.sum("value"), 2), "max_value": F.max("value")}),
        "order_lines": agg("order_lines", lines, F.col("l_orderkey"), {
            "n_lines": n, "sum_qty": F.sum("l_quantity"),
            "avg_discount": F.round(F.sum("l_discount"), 2) / n,
            "sum_price": F.round(F.sum("l_extendedprice"), 2)}),
        "ship_days": agg("ship_days", lines, _day("l_shipdate"), {
            "n_lines": n, "sum_qty": F.sum("l_quantity"), "max_price": F.max("l_extendedprice")}),
        "event_days": agg("event_days", events, _day("ts"), {
            "n_events": n, "sum_value": F.round(F.sum("value"), 2)}),
    }


def cells(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The lake (or the named datasets of it) as one table of cells."""
    all_parts = parts(spark, sf_dir)
    out = None
    for n in names or list(all_parts):
        out = all_parts[n] if out is None else out.unionByName(all_parts[n])
    return out


def stored_cells(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The same, written once: a lake is ingested before it is queried many times over."""
    return materialise(cells(spark, sf_dir, *names))


def single_cells(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return cells(spark, sf_dir, *names).withColumn(
        "dataset_id", F.concat_ws("/", "dataset_id", "col"))


def pairs(spark: SparkSession, *queries: str) -> DataFrame:
    rows = [p for p in PAIRS if not queries or p[0] in queries]
    return spark.createDataFrame(rows, "query_id string, target string, candidate_id string")


def queries_frame(spark: SparkSession, *queries: str) -> DataFrame:
    rows = [q for q in QUERIES if not queries or q[0] in queries]
    return spark.createDataFrame(rows, "query_id string, target string")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source tables to be cut into pairs, with ``row_ord``, the order of their rows."""
    def t(n):
        return table(spark, sf_dir, n)
    line_key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    def src(name, df, key, order, columns):
        wide = df.select(key.cast("string").alias("row_key"), order.cast("long").alias("row_ord"),
                         *[F.expr(e).cast("double").alias(c) for c, e in columns.items()])
        return wide.unpivot(["row_key", "row_ord"], list(columns), "col", "v").select(
            F.lit(name).alias("dataset_id"), "row_key", "row_ord", "col", "v")
    lines = t("lineitem").groupBy(line_key.alias("__key"), "l_orderkey").agg(
        *[F.max(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    keys = {"lineitem": (lines, F.col("__key"), F.col("l_orderkey")),
            "part": (t("part"), F.col("p_partkey"), F.col("p_partkey")),
            "customer": (t("customer"), F.col("c_custkey"), F.col("c_custkey")),
            "supplier": (t("supplier"), F.col("s_suppkey"), F.col("s_suppkey"))}
    out = None
    for name, (df, key, order) in keys.items():
        one = src(name, df, key, order, SOURCE_COLUMNS[name])
        out = one if out is None else out.unionByName(one)
    return out


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large table of scored pairs: each supplier is a query, each of its parts a candidate.

    Scores before and after, the predicted gain, p(gain) and the baselines are read off
    the lines of that pair with minima and maxima only.
    """
    li = table(spark, sf_dir, "lineitem")
    per = li.groupBy("l_suppkey", "l_partkey").agg(
        F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.max("l_quantity").alias("q"),
        F.min("l_extendedprice").alias("p"), F.min("l_linenumber").alias("ln"),
        F.min("l_orderkey").alias("o"), F.max("l_shipdate").alias("s"))
    before, after = F.col("d") * 5.0, F.col("t") * 10.0 - F.col("q") / 100.0
    gain = (after - before) / F.abs(F.nullif(before, F.lit(0.0)))
    p_gain = (F.col("o") % 101) / 101.0
    return per.select(
        F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("query_id"),
        F.lit("l_extendedprice").alias("target"),
        F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("candidate_id"),
        before.alias("r2_before"), after.alias("r2_after"), gain.alias("gain"),
        (F.col("q") / 25.0 - F.col("ln") / 4.0).alias("predicted_gain"),
        p_gain.alias("p_gain"),
        F.when(p_gain > 0.5, "gain").otherwise("loss").alias("pred_class"),
        F.when(gain > 0, "gain").otherwise("loss").alias("class"),
        (F.col("q") / 50.0).alias("containment"),
        (F.col("t") * 8.0 - F.col("d") * 3.0).alias("pearson_difference"),
        (F.col("p") / 1000.0).alias("price"),
        F.col("s").alias("ts"),
        F.when(F.col("o") % 2 == 0, "positive").otherwise("negative").alias("gain_marker"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instances whose gain exists."""
    return instances(spark, sf_dir).where("gain is not null")


# ---- the same tables for DuckDB -------------------------------------------------------------

def _sql_melt(dataset: str, source: str, key: str, columns: dict[str, str], extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset_id, CAST({key} AS VARCHAR) AS row_key, "
        f"{extra}'{n}' AS col, CAST({e} AS DOUBLE) AS v FROM {source}" for n, e in columns.items())


def _sql_agg(dataset: str, source: str, key: str, columns: dict[str, str]) -> str:
    inner = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return _sql_melt(dataset, f"(SELECT {key} AS k, {inner} FROM {source} GROUP BY 1)", "k",
                     {n: n for n in columns})


_PARTS_SQL = {
    "customer": _sql_melt("customer", "customer", "c_custkey", {
        "c_acctbal": "c_acctbal", "c_nationkey": "c_nationkey"}),
    "orders": _sql_melt("orders", "orders", "o_orderkey", {
        "o_totalprice": "o_totalprice", "o_priority": "CAST(o_orderpriority[1:1] AS DOUBLE)"}),
    "order_days": _sql_agg("order_days", "orders", "strftime(o_orderdate, '%Y-%m-%d')", {
        "n_orders": "count(*)", "max_price": "max(o_totalprice)",
        "n_urgent": "count(*) FILTER (o_orderpriority = '1-URGENT')"}),
    "cust_orders": _sql_agg("cust_orders", "orders", "o_custkey", {
        "n_orders": "count(*)", "sum_price": "round(sum(o_totalprice), 2)",
        "max_price": "max(o_totalprice)", "avg_price": "round(sum(o_totalprice), 2) / count(*)"}),
    "user_events": _sql_agg("user_events", "events", "user_id", {
        "n_events": "count(*)", "sum_value": "round(sum(value), 2)", "max_value": "max(value)"}),
    "order_lines": _sql_agg("order_lines", "lineitem", "l_orderkey", {
        "n_lines": "count(*)", "sum_qty": "sum(l_quantity)",
        "avg_discount": "round(sum(l_discount), 2) / count(*)",
        "sum_price": "round(sum(l_extendedprice), 2)"}),
    "ship_days": _sql_agg("ship_days", "lineitem", "strftime(l_shipdate, '%Y-%m-%d')", {
        "n_lines": "count(*)", "sum_qty": "sum(l_quantity)", "max_price": "max(l_extendedprice)"}),
    "event_days": _sql_agg("event_days", "events", "strftime(ts, '%Y-%m-%d')", {
        "n_events": "count(*)", "sum_value": "round(sum(value), 2)"}),
}


def cells_sql(*names: str) -> str:
    return " UNION ALL ".join(_PARTS_SQL[n] for n in (names or _PARTS_SQL))


def single_cells_sql(*names: str) -> str:
    return (f"SELECT dataset_id || '/' || col AS dataset_id, row_key, col, v "
            f"FROM ({cells_sql(*names)})")


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS x({names})"


def pairs_sql(*queries: str) -> str:
    return _values([p for p in PAIRS if not queries or p[0] in queries],
                   "query_id, target, candidate_id")


def queries_sql(*queries: str) -> str:
    return _values([q for q in QUERIES if not queries or q[0] in queries], "query_id, target")


def sources_sql() -> str:
    key = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
    lines = (f"(SELECT {key} AS k, l_orderkey, "
             + ", ".join(f"max({c}) AS {c}" for c in SOURCE_COLUMNS["lineitem"])
             + " FROM lineitem GROUP BY 1, 2)")
    keys = {"lineitem": (lines, "k", "l_orderkey"), "part": ("part", "p_partkey", "p_partkey"),
            "customer": ("customer", "c_custkey", "c_custkey"),
            "supplier": ("supplier", "s_suppkey", "s_suppkey")}
    return " UNION ALL ".join(
        _sql_melt(name, frm, k, SOURCE_COLUMNS[name], f"CAST({order} AS BIGINT) AS row_ord, ")
        for name, (frm, k, order) in keys.items())


INSTANCES_SQL = """
SELECT 'supplier/' || l_suppkey AS query_id, 'l_extendedprice' AS target,
       'part/' || l_partkey AS candidate_id, before AS r2_before, after AS r2_after, gain,
       q / 25.0::DOUBLE - ln / 4.0::DOUBLE AS predicted_gain, p_gain,
       CASE WHEN p_gain > 0.5 THEN 'gain' ELSE 'loss' END AS pred_class,
       CASE WHEN gain > 0 THEN 'gain' ELSE 'loss' END AS class,
       q / 50.0::DOUBLE AS containment, t * 8.0::DOUBLE - d * 3.0::DOUBLE AS pearson_difference,
       p / 1000.0::DOUBLE AS price, s AS ts,
       CASE WHEN o % 2 = 0 THEN 'positive' ELSE 'negative' END AS gain_marker
FROM (SELECT *, (after - before) / abs(nullif(before, 0)) AS gain, (o % 101) / 101.0::DOUBLE AS p_gain
      FROM (SELECT *, d * 5.0::DOUBLE AS before, t * 10.0::DOUBLE - q / 100.0::DOUBLE AS after
            FROM (SELECT l_suppkey, l_partkey, max(l_discount) AS d, max(l_tax) AS t,
                         max(l_quantity) AS q, min(l_extendedprice) AS p, min(l_linenumber) AS ln,
                         min(l_orderkey) AS o, max(l_shipdate) AS s
                  FROM lineitem GROUP BY 1, 2)))
"""
SCORED_SQL = f"SELECT * FROM ({INSTANCES_SQL}) WHERE gain IS NOT NULL"


# ---- a lake of many queries: the customers of each nation -------------------------------------

CANDIDATES = ("cust_orders", "user_events")


def nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query dataset per nation (target ``c_acctbal``) and every candidate column by itself."""
    wide = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("dataset_id"),
        F.col("c_custkey").cast("string").alias("row_key"),
        F.col("c_acctbal"), F.ascii("c_mktsegment").cast("double").alias("segment"))
    bases = wide.unpivot(["dataset_id", "row_key"], ["c_acctbal", "segment"], "col", "v")
    return bases.unionByName(single_cells(spark, sf_dir, *CANDIDATES))


def nation_pairs(cells_: DataFrame) -> DataFrame:
    """Every nation with every candidate column: both lists are as short as the schema."""
    names = cells_.select("dataset_id").distinct()
    is_base = F.col("dataset_id").startswith("nation/")
    columns = F.array(*[F.lit(f"{d}/{c}") for d, cs in {
        "cust_orders": ("n_orders", "sum_price", "max_price", "avg_price"),
        "user_events": ("n_events", "sum_value", "max_value")}.items() for c in cs])
    return names.where(is_base).select(
        F.col("dataset_id").alias("query_id"), F.lit("c_acctbal").alias("target"),
        F.explode(columns).alias("candidate_id"))


_NATION = "SELECT 'nation/' || c_nationkey AS dataset_id, c_custkey::VARCHAR AS row_key, "
NATION_PAIRS_SQL = (
    "SELECT 'nation/' || n AS query_id, 'c_acctbal' AS target, candidate_id FROM (SELECT DISTINCT c_nationkey AS n FROM customer), "
    f"(SELECT DISTINCT dataset_id AS candidate_id FROM ({single_cells_sql(*CANDIDATES)}))")


def nation_cells_sql() -> str:
    return (_NATION + "'c_acctbal' AS col, c_acctbal::DOUBLE AS v FROM customer UNION ALL " + _NATION
            + f"'segment', ascii(c_mktsegment)::DOUBLE FROM customer UNION ALL {single_cells_sql(*CANDIDATES)}")
