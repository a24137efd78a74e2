"""Association of columns with a target (and with each other) over many pairs at once."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinlift.functions import attach, average_ranks, cumulate, deal, materialise, max_modulus, meet, pearson
from joinlift.functions.exprs import zero_if_undefined
from joinlift.functions.spread import SPLIT_ROWS, has_large_group
from joinlift.operators import joins
from joinlift.schema import ASSOCIATION_FEATURES, PAIR

GROUP = [*PAIR, "col"]
RADIX = 16


def aligned(pairs: DataFrame, cells: DataFrame, impute: str | None = "mean") -> DataFrame:
    """Rows ``(pair, col, row_key, x, y)``: each candidate column next to the query's target.

    With ``impute='mean'`` every query row takes part and a missing x is the mean of the matched
    ones (0 where nothing matches); with ``None`` only matched rows take part.

    A query's key may repeat: each of its rows meets the candidate's value, and its own columns
    are told apart by ``row_id`` where ``cells`` has it. A repeated key of a candidate is averaged.

    The join runs on whole candidate rows (one map of cells per key), not on single cells.
    """
    if impute not in ("mean", None):
        raise ValueError(f"unknown imputation {impute!r}")
    kept = ["row_key", "row_id"] if "row_id" in cells.columns else ["row_key"]
    cells = joins.with_row_id(cells)
    # a dataset's own columns meet its target row by row, all others by key
    own = F.col("query_id") == F.col("candidate_id")
    at = F.when(F.col("own"), F.col("row_id")).otherwise(F.col("row_key")).alias("at")
    pairs = materialise(pairs.select(*PAIR).distinct().withColumn("own", own))
    y = meet(cells.where("v is not null").select(
        F.col("dataset_id").alias("query_id"), F.col("col").alias("target"), "row_key", "row_id",
        F.col("v").alias("y")), pairs, ["query_id", "target"], ["row_key"]).select(*PAIR, "own", *kept, at, "y")
    used = pairs.select("candidate_id", "own").distinct()
    theirs = meet(cells.withColumnRenamed("dataset_id", "candidate_id"), used, ["candidate_id"], ["row_key", "col"])
    # a repeated key is averaged first, so a frequent key never fills a map
    unique = theirs.where("v is not null").groupBy("candidate_id", "own", at, "col").agg(
        F.avg("v").alias("x"))
    rows = unique.groupBy("candidate_id", "own", "at").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "x"))).alias("xs"))
    own_target = F.col("own") & (F.col("col") == F.col("target"))
    side = ["candidate_id", "own", "at"]
    if impute is None:
        met = y.join(rows, side)
        return met.select(*PAIR, "own", *kept, "y", F.explode("xs").alias("col", "x")).where(~own_target).select(
            *GROUP, *kept, "x", "y")
    met = y.join(rows, side, "left")
    means = met.select(*PAIR, F.explode("xs").alias("col", "x")).groupBy(*GROUP).agg(F.avg("x").alias("m"))
    columns = pairs.join(theirs.select("candidate_id", "own", "col").distinct(), ["candidate_id", "own"]).where(
        ~own_target).join(means, GROUP, "left")
    per_pair = columns.groupBy(*PAIR).agg(F.collect_list(F.struct("col", "m")).alias("ms"))
    full = attach(met, per_pair, PAIR, kept, how="inner")

    def filled(m):
        return F.struct(m["col"].alias("col"), F.coalesce(F.element_at("xs", m["col"]), m["m"], F.lit(0.0)).alias("x"))
    return full.select(*PAIR, *kept, "y", F.inline(F.transform("ms", filled))).select(*GROUP, *kept, "x", "y")


def own_pairs(queries: DataFrame) -> DataFrame:
    """Treat a query's remaining columns as its own candidate."""
    return queries.select("query_id", "target", F.col("query_id").alias("candidate_id")).distinct()


def linear(rows: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Pearson (0 where a side is constant) and sample covariance; one partial aggregation."""
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        zero_if_undefined(pearson("x", "y")).alias("pearson"),
        F.covar_samp("x", "y").alias("covariance"))


def joint_counts(rows: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """How often each (x, y) occurs; the shared, stored input of rank and information measures."""
    return materialise(rows.groupBy(*group, "x", "y").agg(F.count(F.lit(1)).alias("c")))


def _marginal(joint: DataFrame, group: list[str], side: str) -> DataFrame:
    return joint.groupBy(*group, side).agg(F.sum("c").alias("c"))


def _ranked_in_place(joint: DataFrame, group: list[str]) -> DataFrame:
    """Ranks by windows: one shuffle, for groups that fit a task."""
    g = Window.partitionBy(*group)
    def rank(side):
        ties = F.sum("c").over(Window.partitionBy(*group, side))
        return F.sum("c").over(g.orderBy(side)) - ties + (ties + 1) / 2
    return joint.select(*group, "c", rank("x").alias("rx"), rank("y").alias("ry"),
                        F.sum("c").over(g).alias("n"))


def _ranked_by_join(joint: DataFrame, group: list[str], **kw) -> DataFrame:
    """Ranks of the distinct values, found in ranges and joined back: for groups of any size."""
    rx = average_ranks(_marginal(joint, group, "x"), group, "x", "c", "rx", "n", **kw).drop("c")
    ry = average_ranks(_marginal(joint, group, "y"), group, "y", "c", "ry", "ny", **kw).drop("c")
    # merge joins, which the adaptive planner can split where one value is frequent
    return joint.join(rx.hint("merge"), [*group, "x"]).join(ry.hint("merge"), [*group, "y"]).select(
        *group, "c", "rx", "ry", "n")


def spearman(joint: DataFrame, group: list[str] = GROUP, **kw) -> DataFrame:
    """Correlation of average ranks; 0 where a side is constant."""
    limit = kw.get("split_rows", SPLIT_ROWS)
    both = (_ranked_by_join(joint, group, **kw) if has_large_group(joint, group, limit)
            else _ranked_in_place(joint, group))
    a = F.col("rx") - (F.col("n") + 1) / 2   # ranks about their known mean
    b = F.col("ry") - (F.col("n") + 1) / 2
    c = F.col("c")
    parts = both.groupBy(*group).agg(
        F.sum(c * a * b).alias("ab"), F.sum(c * a * a).alias("aa"), F.sum(c * b * b).alias("bb"))
    scale = F.nullif(F.sqrt(F.col("aa") * F.col("bb")), F.lit(0.0))
    return parts.select(*group, zero_if_undefined(F.col("ab") / scale).alias("spearman"))


def _entropy_parts(counts: DataFrame, group: list[str], name: str) -> DataFrame:
    c = F.col("c")
    return counts.groupBy(*group).agg(F.sum(c * F.ln(c)).alias(name), F.sum(c).alias(f"n_{name}"),
                                      F.count(F.lit(1)).alias(f"k_{name}"))


def normalised_mutual_information(joint: DataFrame, group: list[str] = GROUP,
                                  norm: str = "geometric") -> DataFrame:
    """Mutual information of exact values over the mean entropy."""
    j = _entropy_parts(joint, group, "j")
    x = _entropy_parts(_marginal(joint, group, "x"), group, "x")
    y = _entropy_parts(_marginal(joint, group, "y"), group, "y")
    n = F.col("n_j")
    def entropy(part):
        return F.ln(n) - F.col(part) / n
    hx, hy = entropy("x"), entropy("y")
    mean = F.sqrt(hx * hy) if norm == "geometric" else (hx + hy) / 2
    info = hx + hy - entropy("j")
    both_constant = (F.col("k_x") == 1) & (F.col("k_y") == 1)
    either_constant = (F.col("k_x") == 1) | (F.col("k_y") == 1)
    nmi = F.when(both_constant, 1.0).when(either_constant | (info <= 2.3e-16), 0.0).otherwise(
        info / mean)
    return j.join(x, group).join(y, group).select(*group, nmi.alias("mutual_info"))


def discordant_pairs(joint: DataFrame, group: list[str], **kw) -> DataFrame:
    """Number of discordant row pairs per group in n log n work.

    y becomes its place among the distinct y, written in base 16. Two rows are discordant exactly
    when, at the first digit where their y differ, the row with smaller x has the
    larger digit; one running count per digit finds them, for all digits at once.
    """
    order = positions_of(_marginal(joint, group, "y"), group, "y", **kw)
    placed = joint.join(order, [*group, "y"])
    # the number of base-16 digits, in whole numbers: a 64-bit count has at most 16
    bits = F.length(F.bin(F.col("yn") - 1))
    last = F.floor((bits - 1) / 4).cast("int")
    levels = placed.withColumn("level", F.explode(F.sequence(F.lit(0), last)))
    scale = F.pow(F.lit(float(RADIX)), F.col("level")).cast("long")
    digits = levels.select(
        *group, "level", "x", "c",
        F.floor(F.col("yp") / (scale * RADIX)).alias("node"),
        F.pmod(F.floor(F.col("yp") / scale), F.lit(RADIX)).alias("digit"))
    node = [*group, "level", "node"]
    per_x = digits.groupBy(*node, "x").agg(*[
        F.sum(F.when(F.col("digit") == d, F.col("c")).otherwise(0)).alias(f"d{d}")
        for d in range(RADIX)])
    run = cumulate(per_x, node, ["x"], {f"b{d}": F.col(f"d{d}") for d in range(1, RADIX)},
                   totals=False, **kw)
    larger, found = F.lit(0.0), F.lit(0.0)
    for d in range(RADIX - 2, -1, -1):
        larger = larger + F.col(f"b{d + 1}")
        found = found + F.col(f"d{d}") * larger
    return run.groupBy(*group).agg(F.sum(found).alias("discordant"))


def positions_of(values: DataFrame, group: list[str], value: str, **kw) -> DataFrame:
    run = cumulate(values, group, [value], {"yp": F.lit(1)}, **kw)
    return run.select(*group, value, "yp", F.col("yp_total").alias("yn"))


def _tied(counts: np.ndarray, *sides: np.ndarray) -> float:
    """Pairs of rows that agree on all sides."""
    order = np.lexsort(sides)
    starts = np.ones(len(order), bool)
    starts[1:] = np.any([s[order][1:] != s[order][:-1] for s in sides], axis=0)
    c = np.add.reduceat(counts[order], np.flatnonzero(starts))
    return float((c * (c - 1)).sum() / 2)


def _codes(side: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers in the order of the values; NaN is one value, above all others."""
    return np.unique(side.to_numpy(), return_inverse=True)[1].astype(np.int64)


def tau_b(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> float:
    """Kendall tau-b of coded (x, y), each ``counts`` times; NaN where a side is constant.

    From the highest bit of y down, rows of equal higher bits stay in the order of x: a row without the bit is discordant with
    those before it that have it.
    """
    order = np.lexsort((y, x))
    at, c, discordant = y[order], counts[order], 0.0
    for bit in range(int(at.max()).bit_length() - 1, -1, -1):
        node, has = at >> (bit + 1), (at >> bit) & 1 == 1
        run = np.cumsum(np.where(has, c, 0.0))
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        before = np.repeat(np.r_[0.0, run[first[1:] - 1]], np.diff(np.r_[first, len(node)]))
        discordant += float((c * (run - before))[~has].sum())
        place = np.argsort(at >> bit, kind="stable")
        at, c = at[place], c[place]
    n = float(counts.sum())
    pairs, tx, ty = n * (n - 1) / 2, _tied(counts, x), _tied(counts, y)
    scale = np.sqrt((pairs - tx) * (pairs - ty))
    return (pairs - tx - ty + _tied(counts, x, y) - 2 * discordant) / scale if scale > 0 else float("nan")


def kendall_in_tasks(rows: DataFrame, group: list[str], sides: Mapping[str, tuple[str, str]], count: str | None = None) -> DataFrame:
    """Kendall tau-b of several pairs of columns at once, for stored groups that fit a task; 0 where a side is constant.

    Groups with a null in their name have no row. No side may be null.
    """
    names = list(dict.fromkeys(c for pair in sides.values() for c in pair))
    known = rows.where(reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group]))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(table: pa.Table) -> pa.Table:
        codes = {c: _codes(table[c]) for c in names}
        counts = np.ones(len(table)) if count is None else table[count].to_numpy().astype(np.float64)
        found = {name: tau_b(codes[x], codes[y], counts) for name, (x, y) in sides.items()}
        return pa.table({**{g: table[g].slice(0, 1) for g in group}, **{n: pa.array([v if v == v else 0.0]) for n, v in found.items()}})
    schema = ", ".join([*[f"`{g}` {types[g]}" for g in group], *[f"`{n}` double" for n in sides]])
    return deal(known.select(*group, *names, *([count] if count else [])), group).groupBy(*group).applyInArrow(run, schema)


def kendall(joint: DataFrame, group: list[str] = GROUP, **kw) -> DataFrame:
    """Kendall tau-b; 0 where a side is constant. Groups that fit a task are counted there, larger ones digit by digit."""
    if not has_large_group(joint, group, kw.get("split_rows", SPLIT_ROWS)) and joint.where("x is null or y is null").isEmpty():
        return kendall_in_tasks(joint, group, {"kendall": ("x", "y")}, "c")

    def ties(counts, name):
        c = F.col("c").cast("double")
        return counts.groupBy(*group).agg(F.sum(c * (c - 1)).alias(name))
    n = joint.groupBy(*group).agg(F.sum("c").cast("double").alias("n"))
    parts = (n.join(discordant_pairs(joint, group, **kw), group)
             .join(ties(_marginal(joint, group, "x"), "tx"), group)
             .join(ties(_marginal(joint, group, "y"), "ty"), group)
             .join(ties(joint, "txy"), group))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    tx, ty, txy = (F.col(t) / 2 for t in ("tx", "ty", "txy"))
    diff = pairs - tx - ty + txy - 2 * F.col("discordant")
    scale = F.nullif(F.sqrt((pairs - tx) * (pairs - ty)), F.lit(0.0))
    return parts.select(*group, zero_if_undefined(diff / scale).alias("kendall"))


def measures(rows: DataFrame, group: list[str] = GROUP, *, norm: str = "geometric",
             with_kendall: bool = False) -> DataFrame:
    """All association measures per column."""
    rows = materialise(rows)
    joint = joint_counts(rows, group)
    out = (linear(rows, group).join(spearman(joint, group), group)
           .join(normalised_mutual_information(joint, group, norm), group))
    return out.join(kendall(joint, group), group) if with_kendall else out


# ---- mean-filled columns, from the matched rows alone ----------------------------------------------
#
# A filled row has x = m, the mean of the matched x. It adds nothing to the co-moments of x about m, and it sits in one tie of x
# with every other filled row. So the rows that meet no candidate key are never made: what they add to a sum follows from the target's own
# totals, less what the matched rows hold of them.

class Matched(NamedTuple):
    """``rows`` (gid, x, y, ry, cy): matched rows with the target's rank and the number of rows that share it.
    ``columns`` (gid, pair, col, n, n_matched, m, xx, xy, ...): all columns with counts, mean and co-moments, and the target's totals.
    ``gid`` numbers the columns of pairs, so that rows carry one number instead of four names."""

    rows: DataFrame
    columns: DataFrame


def _f(c: Column) -> Column:
    """c ln c, 0 for 0."""
    return F.when(c > 0, c * F.ln(c)).otherwise(0.0)


def targets_of(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """(query_id, target, row_key, y): the rows of each target, once, however many pairs it has."""
    asked = pairs.select("query_id", "target").distinct()
    values = cells.where("v is not null").select(F.col("dataset_id").alias("query_id"), F.col("col").alias("target"), "row_key", F.col("v").alias("y"))
    return meet(values, asked, ["query_id", "target"], ["row_key"], "left_semi")


def ranked_targets(pairs: DataFrame, cells: DataFrame, split_rows: int | None = None) -> DataFrame:
    """``targets_of`` with ``ry``, the average rank of y, and ``cy``, the number of rows that share it. Stored."""
    side = ["query_id", "target"]
    rows = targets_of(pairs, cells)
    limit = SPLIT_ROWS if split_rows is None else split_rows
    if has_large_group(rows, side, limit):
        counts = rows.groupBy(*side, "y").agg(F.count(F.lit(1)).alias("c"))
        ranks = average_ranks(counts, side, "y", "c", "ry", "n", split_rows=limit).withColumnRenamed("c", "cy")
        return materialise(rows.join(ranks.drop("n").hint("merge"), [*side, "y"]))
    w = Window.partitionBy(*side).orderBy("y")
    first = F.rank().over(w)
    last = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return materialise(rows.withColumns({"ry": (first + last) / 2, "cy": last - first + 1}))


def target_totals(targets: DataFrame) -> DataFrame:
    """Per target: rows ``n``, sum of squares ``yy`` about the mean and, of ranked ones, ``rr`` of the ranks, ``fy`` and ``ky`` of the tied groups."""
    aggs = [F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("v")]
    if "ry" in targets.columns:
        aggs += [F.var_pop("ry").alias("vr"), F.sum(F.ln("cy")).alias("fy"), F.round(F.sum(1 / F.col("cy"))).alias("ky")]
    sums = targets.groupBy("query_id", "target").agg(*aggs).withColumn("yy", F.col("v") * F.col("n")).drop("v")
    return sums.withColumn("rr", F.col("vr") * F.col("n")).drop("vr") if "ry" in targets.columns else sums


def match(pairs: DataFrame, cells: DataFrame, *, ranks: bool = True, split_rows: int | None = None) -> Matched:
    """The matched rows of pairs of different datasets; a repeated key of a candidate is averaged, one of a query keeps its rows.

    ``ranks=False`` is enough for ``matched_linear``, and stores nothing.
    """
    pairs = materialise(pairs.select(*PAIR).distinct().where("query_id <> candidate_id"))
    targets = ranked_targets(pairs, cells, split_rows) if ranks else targets_of(pairs, cells)
    used = pairs.select("candidate_id").distinct()
    theirs = meet(cells.withColumnRenamed("dataset_id", "candidate_id"), used, ["candidate_id"], ["row_key", "col"], "left_semi")
    unique = theirs.where("v is not null").groupBy("candidate_id", "row_key", "col").agg(F.avg("v").alias("x"))
    names = materialise(pairs.join(theirs.select("candidate_id", "col").distinct(), "candidate_id").withColumn(
        "gid", F.monotonically_increasing_id()))                      # stored, so that the numbers stay
    met = meet(targets, pairs, ["query_id", "target"], ["row_key"]).join(unique, ["candidate_id", "row_key"])
    rows = meet(met, names, GROUP, ["row_key"]).select("gid", "x", "y", *(["ry", "cy"] if ranks else []))
    rows = materialise(rows) if ranks else rows
    moments = rows.groupBy("gid").agg(
        F.count(F.lit(1)).alias("n_matched"), F.avg("x").alias("m"), F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("cxy"))
    k = F.coalesce("n_matched", F.lit(0))
    columns = names.join(target_totals(targets), ["query_id", "target"]).join(moments, "gid", "left").withColumns({
        "n_matched": k, "m": F.coalesce("m", F.lit(0.0)), "xx": F.coalesce(F.col("vx") * k, F.lit(0.0)),
        "xy": F.coalesce(F.col("cxy") * k, F.lit(0.0))}).drop("vx", "cxy")
    return Matched(rows, materialise(columns) if ranks else columns)


def matched_linear(of: Matched) -> DataFrame:
    """(pair, col, n, pearson, covariance) with a missing x at the mean of the matched ones."""
    scale = F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))
    return of.columns.select(*GROUP, "n", zero_if_undefined(F.col("xy") / scale).alias("pearson"),
                             (F.col("xy") / F.nullif(F.col("n") - 1, F.lit(0))).alias("covariance"))


def matched_spearman(of: Matched, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(pair, col, spearman); filled rows are one tie whose rank and sums follow from counts."""
    middle = (F.col("n") + 1) / 2
    values = of.rows.groupBy("gid", "x").agg(F.count(F.lit(1)).alias("c"), F.sum("ry").alias("s"))
    if of.columns.where(F.col("n_matched") > split_rows).isEmpty():
        w = Window.partitionBy("gid").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
        run = values.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    else:
        run = cumulate(values, ["gid"], ["x"], {"before": F.col("c")}, totals=False, split_rows=split_rows)
    met = meet(run, of.columns.select("gid", "n", "n_matched", "m", "rr"), ["gid"], ["x"])
    missing = F.col("n") - F.col("n_matched")
    off = F.col("s") - F.col("c") * middle
    rank = F.col("before") + F.when(F.col("x") > F.col("m"), missing).otherwise(0) + (F.col("c") + 1) / 2 - middle
    at_mean, other = F.col("x") == F.col("m"), F.col("x") != F.col("m")

    def over(mask, value):
        return F.sum(F.when(mask, value).otherwise(0.0))
    sums = met.groupBy("gid").agg(
        over(other, rank * off).alias("ab"), over(other, F.col("c") * rank * rank).alias("aa"), F.sum(off).alias("t"), over(at_mean, off).alias("tm"),
        over(F.col("x") < F.col("m"), F.col("c")).alias("below"), over(at_mean, F.col("c")).alias("equal"),
        F.max(missing).alias("missing"), F.max("n").alias("n"), F.max("rr").alias("rr"))
    tied = F.col("equal") + F.col("missing")
    block = F.col("below") + (tied + 1) / 2 - (F.col("n") + 1) / 2
    ab = F.col("ab") + block * (F.col("tm") - F.col("t"))
    aa = F.col("aa") + tied * block * block
    found = sums.select("gid", (ab / F.nullif(F.sqrt(aa * F.col("rr")), F.lit(0.0))).alias("spearman"))
    return of.columns.select("gid", *GROUP).join(found, "gid", "left").select(*GROUP, zero_if_undefined(F.col("spearman")).alias("spearman"))


def matched_information(of: Matched, norm: str = "geometric") -> DataFrame:
    """(pair, col, mutual_info) of exact values; filled rows share one value of x."""
    others = meet(of.rows, of.columns.select("gid", "m"), ["gid"], ["x", "y"]).where("x <> m")
    joint = materialise(others.groupBy("gid", "x", "y").agg(F.count(F.lit(1)).alias("c"), F.first("cy").alias("cy")))
    x = joint.groupBy("gid", "x").agg(F.sum("c").alias("c")).groupBy("gid").agg(
        F.sum(_f(F.col("c"))).alias("fx"), F.count(F.lit(1)).alias("kx"), F.sum("c").alias("held"))
    y = joint.groupBy("gid", "y").agg(F.sum("c").alias("u"), F.sum(_f(F.col("c"))).alias("fc"), F.first("cy").alias("cy")).groupBy("gid").agg(
        F.sum(F.col("fc") + _f(F.col("cy") - F.col("u")) - _f(F.col("cy").cast("double"))).alias("fj"))
    all_ = of.columns.select("gid", *GROUP, "n", "fy", "ky").join(x, "gid", "left").join(y, "gid", "left").na.fill(0, ["fx", "kx", "held", "fj"])
    n, tied = F.col("n"), F.col("n") - F.col("held")
    hx = F.ln(n) - (F.col("fx") + _f(tied.cast("double"))) / n
    hy = F.ln(n) - F.col("fy") / n
    info = hx + hy - (F.ln(n) - (F.col("fj") + F.col("fy")) / n)
    mean = F.sqrt(hx * hy) if norm == "geometric" else (hx + hy) / 2
    kinds = F.col("kx") + F.when(tied > 0, 1).otherwise(0)
    nmi = F.when((kinds == 1) & (F.col("ky") == 1), 1.0).when((kinds == 1) | (F.col("ky") == 1) | (info <= 1e-12), 0.0).otherwise(info / mean)
    return all_.select(*GROUP, nmi.alias("mutual_info"))


def matched_measures(of: Matched, *, norm: str = "geometric") -> DataFrame:
    """Pearson, covariance, Spearman and mutual information per column."""
    return matched_linear(of).join(matched_spearman(of), GROUP).join(matched_information(of, norm), GROUP)


def strongest(per_column: DataFrame, group: list[str] = PAIR, prefix: str = "") -> DataFrame:
    """The 4 association features of a pair: the largest modulus of each measure."""
    sources = ("pearson", "spearman", "covariance", "mutual_info")
    return per_column.groupBy(*group).agg(*[
        zero_if_undefined(max_modulus(F.col(s))).alias(prefix + f)
        for s, f in zip(sources, ASSOCIATION_FEATURES)])


def within_dataset(cells: DataFrame) -> DataFrame:
    """Pairs of columns inside each dataset as ``(dataset_id, col_a, col_b, row_key, x, y)``.

    A row is first gathered into one array of its columns, so nothing is joined; the number of pairs
    follows the number of columns, never the number of rows.
    """
    unique = cells.where("v is not null").groupBy("dataset_id", "row_key", "col").agg(
        F.avg("v").alias("v"))
    row = unique.groupBy("dataset_id", "row_key").agg(
        F.sort_array(F.collect_list(F.struct("col", "v"))).alias("vs"))
    a = row.select("dataset_id", "row_key", "vs", F.posexplode("vs").alias("i", "a"))
    b = a.select("dataset_id", "row_key", "a",
                 F.explode(F.slice("vs", F.col("i") + 2, F.size("vs"))).alias("b"))
    return b.select("dataset_id", F.col("a.col").alias("col_a"), F.col("b.col").alias("col_b"),
                    "row_key", F.col("a.v").alias("x"), F.col("b.v").alias("y"))


def correlation_of(rows: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """Pearson between two columns of the instance table."""
    return rows.groupBy(*(group or [])).agg(pearson(x, y).alias("pearson"),
                                            F.count(F.lit(1)).alias("n"))


def pearson_difference(candidate: Column, query: Column) -> Column:
    return candidate - query
