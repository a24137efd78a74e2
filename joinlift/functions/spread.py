"""Ordered work (ranks, running sums, medians) that never puts a large group in one task.

A plain window sorts each group inside a single task. The functions here first
count the groups. Where all are small the plain window is used; otherwise a group is
cut into ranges by a sample of its own order keys, each range is sorted in its own
task, and the ranges are stitched together with one offset row per range.
The sample is chosen by hash, so a lost and re-run task sees the same ranges.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPLIT_ROWS = 2_000_000   # a group above this many rows is cut into ranges
SLOTS = 1024             # sampled cut points per large group
SALTS = 32               # copies of a per-group row when it meets the group's rows
ACCURACY = 1_000         # of the quantiles that bracket a middle: ranks are off by at most 1/ACCURACY of the rows
HASH_SLICES = 4096       # slices of the md5 range in hash_order
FEW_ROWS = 100_000       # a table of pairs or ids up to this many rows is broadcast
TASK_ROWS = 250_000      # rows of small groups that share a task


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only in local mode, where none is configured."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if where is None:
        if known is None and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = known if known is not None else tempfile.mkdtemp(prefix="joinlift-")
    if known is None:
        sc.setCheckpointDir(where)
    return where


def materialise(df: DataFrame) -> DataFrame:
    """Write once, read many: for a costly intermediate with several consumers.

    A Parquet table in the shared folder survives lost executors, and later steps read only
    the columns they need and know its size.
    """
    path = f"{shared_dir(df.sparkSession)}/joinlift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], spread: Sequence[str],
           how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join one-row-per-group values onto rows, spreading a hot group over ``salts`` keys.

    ``spread`` names the columns of ``rows`` that tell its rows of one group apart.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = per_group.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def meet(rows: DataFrame, few: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with a stored table that names their groups (pairs, ids): broadcast behind a count of it, else over salted keys.

    Either way the rows of one dataset stay spread out, as large as it may be.
    """
    if few.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return rows.join(F.broadcast(few), list(keys), how)
    return attach(rows, few, keys, spread, how)


def with_one_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Put the single row of a global aggregate on every row; its size is one by construction."""
    return rows.join(F.broadcast(one))


def has_large_group(rows: DataFrame, group: Sequence[str], split_rows: int) -> bool:
    """A count per group, so that windows are used only behind a check of their size."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    return bool(sizes.where(F.col("__n") > split_rows).select(F.lit(1)).take(1))


def deal(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Stored rows dealt out by their groups, to tasks whose number follows the rows: what a task holds does not grow with the table."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-n // TASK_ROWS), min(cores, -(-n * 16 // TASK_ROWS)))
    return rows.repartition(tasks, *group)


def _range_index(cuts: Column, key: Column, slots: int) -> Column:
    """Binary search: how many cut points lie strictly below the key."""
    step = 1
    while step * 2 <= slots:
        step *= 2
    steps = []
    while step >= 1:
        steps.append(step)
        step //= 2
    probe = F.array(*[F.lit(s) for s in steps])
    found = F.aggregate(
        probe, F.lit(0),
        lambda at, s: F.when(F.get(cuts, at + s - 1) < key, at + s).otherwise(at))
    return F.coalesce(found, F.lit(0))


def _in_ranges(rows: DataFrame, group: Sequence[str], order: Sequence[str],
               split_rows: int, slots: int) -> DataFrame:
    """Add ``__range``: the index of the row's range inside its group."""
    key = F.struct(*[F.col(c) for c in order])
    slotted = rows.select(*group, key.alias("__key"), F.xxhash64(*order).alias("__h"))
    sampled = (slotted.groupBy(*group, F.pmod("__h", F.lit(slots)).alias("__slot"))
               .agg(F.count(F.lit(1)).alias("__c"), F.min_by("__key", "__h").alias("__cut")))
    cuts = (sampled.groupBy(*group)
            .agg(F.sum("__c").alias("__n"), F.sort_array(F.collect_list("__cut")).alias("__cuts"))
            .where(F.col("__n") > split_rows).drop("__n"))
    met = attach(rows, cuts, group, order)
    return met.withColumn("__range", _range_index(F.col("__cuts"), key, slots)).drop("__cuts")


def cumulate(rows: DataFrame, group: Sequence[str], order: Sequence[str],
             sums: Mapping[str, Column], *, totals: bool = True, split_rows: int | None = None,
             slots: int | None = None, known_small: bool = False) -> DataFrame:
    """Exclusive running sums inside each group, in ascending ``order``.

    For every name in ``sums`` the result gains ``name`` (sum over the rows before)
    and, with ``totals``, ``name_total`` (sum over the group). Give whole numbers: they add up
    the same way in any order. ``order`` should be unique inside a group. ``known_small`` says that the groups' sizes were checked.
    """
    split_rows = SPLIT_ROWS if split_rows is None else split_rows
    slots = SLOTS if slots is None else slots
    marked = rows.select("*", *[e.cast("long").alias(f"__w_{k}") for k, e in sums.items()])
    group = list(group) or ["__all"]
    if group == ["__all"]:
        marked = marked.withColumn("__all", F.lit(0))
    drop = [f"__w_{k}" for k in sums] + ["__all"]

    def before(w):
        return w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    if known_small or not has_large_group(marked, group, split_rows):
        w = Window.partitionBy(*group)
        whole = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return marked.select(
            "*",
            *[F.coalesce(F.sum(f"__w_{k}").over(before(w)), F.lit(0)).alias(k) for k in sums],
            *[F.sum(f"__w_{k}").over(whole).alias(f"{k}_total") for k in sums if totals]).drop(*drop)

    ranged = _in_ranges(materialise(marked), group, order, split_rows, slots)
    ranged = materialise(ranged)
    in_group = Window.partitionBy(*group)
    offsets = (ranged.groupBy(*group, "__range")
               .agg(*[F.sum(f"__w_{k}").alias(f"__r_{k}") for k in sums]))
    # at most slots + 1 rows per group from here on
    offsets = offsets.select(
        *group, "__range",
        *[F.coalesce(F.sum(f"__r_{k}").over(
            in_group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
          .alias(f"__o_{k}") for k in sums],
        *[F.sum(f"__r_{k}").over(in_group).alias(f"{k}_total") for k in sums if totals])
    w = Window.partitionBy(*group, "__range")
    local = ranged.repartition(*group, "__range").select(
        "*", *[F.coalesce(F.sum(f"__w_{k}").over(before(w)), F.lit(0)).alias(f"__l_{k}")
               for k in sums])
    joined = local.join(offsets, [*group, "__range"])
    for k in sums:
        joined = joined.withColumn(k, F.col(f"__l_{k}") + F.col(f"__o_{k}"))
    gone = [f"__{p}_{k}" for p in ("l", "o") for k in sums] + ["__range"]
    return joined.drop(*gone, *drop)


def positions(rows: DataFrame, group: Sequence[str], order: Sequence[str],
              pos: str = "pos", **kw) -> DataFrame:
    """0-based position of every row in its group and, as ``<pos>_total``, the group's size."""
    return cumulate(rows, group, order, {pos: F.lit(1)}, **kw)


def average_ranks(values: DataFrame, group: Sequence[str], value: str, weight: str,
                  rank: str = "rank", total: str = "n", **kw) -> DataFrame:
    """Average rank of each distinct value, given one row per (group, value) with a count."""
    run = cumulate(values, group, [value], {"__before": F.col(weight)}, **kw)
    return run.select(*group, value, weight,
                      (F.col("__before") + (F.col(weight) + 1) / 2).alias(rank),
                      F.col("__before_total").alias(total))


def _middle(run: DataFrame, before: Column, total: Column, group: Sequence[str], value: str, out: str) -> DataFrame:
    lo, hi = F.floor((total - 1) / 2), F.floor(total / 2)

    def holds(at):
        return (before <= at) & (at < before + F.col("__c"))
    return run.where(holds(lo) | holds(hi)).groupBy(*group).agg(((F.min(value) + F.max(value)) / 2).alias(out))


def _near_middle(have: DataFrame, group: Sequence[str], value: str) -> DataFrame | None:
    """Counts (__c) of the values near the middle of each group, with the rows below them and in all; None where a bracket missed.

    Approximate quantiles bracket the middle, and exact counts prove it: only the few values between them need an order.
    """
    keyed = have.select(F.struct(F.lit(0).alias("__one"), *group).alias("__g"), F.col(value).alias("__v"))
    at = F.percentile_approx("__v", [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY], ACCURACY)
    sides = materialise(keyed.groupBy("__g").agg(at.alias("__at")).select(
        "__g", F.get("__at", F.lit(0)).alias("__lo"), F.get("__at", F.lit(1)).alias("__hi")))
    met = meet(keyed, sides, ["__g"], ["__v"])
    v = F.col("__v")
    counts = materialise(met.groupBy("__g").agg(
        F.count_if(v < F.col("__lo")).alias("__below"), F.count_if(v <= F.col("__hi")).alias("__upto"), F.count(F.lit(1)).alias("__n"),
        F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi")))
    n = F.col("__n")
    sound = (F.col("__below") <= F.floor((n - 1) / 2)) & (F.floor(n / 2) < F.col("__upto"))
    if not counts.where(~F.coalesce(sound, F.lit(False))).isEmpty():
        return None
    near = meet(keyed, counts, ["__g"], ["__v"]).where((v >= F.col("__lo")) & (v <= F.col("__hi")))
    return near.groupBy("__g", v.alias(value)).agg(F.count(F.lit(1)).alias("__c"), F.first("__below").alias("__below"), F.first("__n").alias("__n")) \
        .select(*[F.col(f"__g.{g}").alias(g) for g in group], value, "__c", "__below", "__n")


def group_median(rows: DataFrame, group: Sequence[str], value: str, out: str = "median",
                 **kw) -> DataFrame:
    """Exact median per group: the one or two middle values, found by their running count."""
    have = rows.where(F.col(value).isNotNull())
    counted = have.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    limit = kw.get("split_rows")
    large = has_large_group(counted, group, SPLIT_ROWS if limit is None else limit)
    near = _near_middle(have, group, value) if large else None
    if near is not None:
        run = cumulate(near, group, [value], {"__b": F.col("__c")}, **kw)
        return _middle(run, F.col("__b") + F.col("__below"), F.col("__n"), group, value, out)
    run = cumulate(counted, group, [value], {"__b": F.col("__c")}, known_small=not large, **kw)
    return _middle(run, F.col("__b"), F.col("__b_total"), group, value, out)


def hash_order(rows: DataFrame, group: Sequence[str], key: Sequence[str], *, seed: str,
               pos: str = "pos") -> DataFrame:
    """0-based position in md5 order: a shuffle of each group that any retry repeats.

    md5 values spread evenly, so fixed slices of their range balance by themselves.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in key]))
    marked = rows.withColumn("__d", digest).withColumn("__slice", F.substring("__d", 1, 3))
    g = [*group, "__slice"]
    w = Window.partitionBy(*group)
    sizes = marked.groupBy(*g).agg(F.count(F.lit(1)).alias("__c"))
    # at most HASH_SLICES rows per group
    offsets = sizes.select(
        *g, F.coalesce(F.sum("__c").over(
            w.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"),
        F.sum("__c").over(w).alias(f"{pos}_total"))
    local = marked.repartition(*g).withColumn(
        "__l", F.row_number().over(Window.partitionBy(*g).orderBy("__d", *key)) - 1)
    return (local.join(offsets, g)
            .withColumn(pos, F.col("__l") + F.col("__o"))
            .drop("__d", "__slice", "__l", "__o"))
