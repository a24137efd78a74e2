"""Cutting tables into (query, candidate) pairs, and every kind of split, filter and draw."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinlift.functions import hash32, hash_order, with_one_row

FLOAT_MAX = 3.4028235e38   # fixed value: largest 32-bit float
TRAIN_PERCENT = 67


def column_sizes(columns: DataFrame, max_splits: int, max_columns: int) -> DataFrame:
    """Per dataset: free columns, and how many query columns each split may take.

    With more free columns than ``max_splits`` each size occurs once, else each size k as often
    as there are k-subsets. ``sizes`` is that list, spelled as (k, how often).
    """
    free = columns.where("not is_target").groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_free"))
    left = F.least(F.col("n_free"), F.lit(max_columns - 1))
    free = free.withColumn("n_left", left).where("n_left > 1")
    # number of k-subsets, tabulated for the small sizes where it is used
    table = F.create_map(*[
        x for n in range(2, max_splits + 1)
        for x in (F.lit(n), F.array(*[F.lit(min(comb(n, k), max_splits)) for k in range(1, n)]))
    ]) if max_splits >= 2 else None
    once = F.transform(F.sequence(F.lit(1), (F.col("n_left") - 1).cast("int")), lambda k: F.lit(1))
    times = once if table is None else F.when(F.col("n_left") > max_splits, once).otherwise(
        F.element_at(table, F.col("n_left").cast("int")))
    return free.withColumn("times", times)


def make_splits(columns: DataFrame, max_splits: int, max_columns: int,
                single_candidate: bool = False, seed: str = "splits") -> DataFrame:
    """Vertical splits ``(dataset_id, split_no, col, side)``; metadata-sized throughout.

    ``columns``: ``(dataset_id, col, is_target)`` of numeric columns. Query sizes are drawn
    without replacement, columns in md5 order; of equal query column sets the first is kept.
    """
    sizes = column_sizes(columns, max_splits, max_columns)
    slots = sizes.select("dataset_id", "n_left", F.posexplode("times").alias("k0", "times"))
    slots = slots.select("dataset_id", "n_left", (F.col("k0") + 1).alias("k"),
                         F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    order = Window.partitionBy("dataset_id").orderBy(
        hash32("dataset_id", "k", "copy", seed=seed), "k", "copy")
    splits = slots.withColumn("split_no", F.row_number().over(order)).where(
        F.col("split_no") <= max_splits).select("dataset_id", "n_left", "k", "split_no")
    free = columns.where("not is_target").select("dataset_id", "col")
    shuffled = splits.join(free, "dataset_id").withColumn("rn", F.row_number().over(
        Window.partitionBy("dataset_id", "split_no").orderBy(
            hash32("dataset_id", "split_no", "col", seed=seed), "col")))
    take = F.lit(1) if single_candidate else F.col("n_left") - F.col("k")
    sided = shuffled.withColumn("side", F.when(F.col("rn") <= F.col("k"), "query").when(
        F.col("rn") <= F.col("k") + take, "candidate")).where("side is not null")
    sets = sided.where("side = 'query'").groupBy("dataset_id", "split_no").agg(
        F.sort_array(F.collect_list("col")).alias("cols"))
    first = sets.groupBy("dataset_id", "cols").agg(F.min("split_no").alias("split_no"))
    kept = sided.join(first.select("dataset_id", "split_no"), ["dataset_id", "split_no"])
    targets = columns.where("is_target").join(
        first.select("dataset_id", "split_no"), "dataset_id").select(
        "dataset_id", "split_no", "col", F.lit("query").alias("side"))
    return kept.select("dataset_id", "split_no", "col", "side").unionByName(targets)


def project_split(splits: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells of each side of each split, missing values as 0.

    Ids are ``<dataset>#<split>q`` and ``<dataset>#<split>c``.
    """
    named = splits.withColumn("part_id", F.concat(
        "dataset_id", F.lit("#"), F.col("split_no").cast("string"), F.substring("side", 1, 1)))
    return cells.join(named, ["dataset_id", "col"]).select(
        F.col("part_id").alias("dataset_id"), F.col("dataset_id").alias("source"), "split_no",
        "side", "row_key", "col", F.coalesce("v", F.lit(0.0)).alias("v"))


def split_by_hash(rows: DataFrame, key: Sequence[str], train_tenths: int = 7,
                  seed: str = "source-split") -> DataFrame:
    """Rows of one key always fall on the same side."""
    return rows.withColumn("part", F.when(
        hash32(*key, seed=seed) % 10 < train_tenths, "train").otherwise("test"))


def split_by_groups(rows: DataFrame, keys: Sequence[str], train: float, valid: float,
                    seed: str = "group-split") -> DataFrame:
    """Exact shares of the distinct keys: the first ``int(train*n)`` in md5 order, and so on."""
    placed = hash_order(rows.select(*keys).distinct(), [], list(keys), seed=seed)
    n = F.col("pos_total")
    a, b = F.floor(n * train), F.floor(n * valid)
    parts = placed.select(*keys, F.when(F.col("pos") < a, "train").when(
        F.col("pos") < a + b, "valid").otherwise("test").alias("part"))
    return rows.join(parts, list(keys))


def base_name(path: str) -> Column:
    return F.element_at(F.split(F.col(path), "/"), -1)


def by_key_lists(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Keep the (target, query, candidate) named by lines ``target,query,cand,cand,...``."""
    parts = F.split("line", ",")
    keys = lines.select(parts[0].alias("target"), parts[1].alias("query_id"),
                        F.explode(F.slice(parts, 3, F.size(parts))).alias("candidate_id"))
    return rows.join(keys, ["target", "query_id", "candidate_id"], "left_semi")


def folds(rows: DataFrame, key: Sequence[str], k: int, seed: str = "42") -> DataFrame:
    return rows.withColumn("fold", (hash32(*key, seed=seed) % k).cast("int"))


def hold_out(rows: DataFrame, key: str = "row_key", seed: str = "42") -> DataFrame:
    """67/33; the same key is on the same side before and after a join."""
    return rows.withColumn("is_train", hash32(key, seed=seed) % 100 < TRAIN_PERCENT)


def balance_classes(rows: DataFrame, label: str, key: Sequence[str],
                    seed: str = "balance") -> DataFrame:
    """As many rows of every class as the smallest class has, shuffled by md5."""
    placed = hash_order(rows, [label], key, seed=seed)
    smallest = rows.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(
        F.min("c").alias("__least"))
    return with_one_row(placed, smallest).where("pos < __least").drop("pos", "pos_total", "__least")


def draw_per_query(rows: DataFrame, n_queries: int, marker: str | None = None,
                   seed: str = "draw") -> DataFrame:
    """``n_queries`` queries with one row each, or with one row of each marker value."""
    chosen = hash_order(rows.select("query_id").distinct(), [], ["query_id"], seed=seed).where(
        F.col("pos") < n_queries).select("query_id")
    mine = rows.join(chosen, "query_id", "left_semi")
    group = ["query_id"] + ([marker] if marker else [])
    ident = F.struct(hash32("query_id", "target", "candidate_id", seed=seed), "target",
                     "candidate_id")
    # min_by combines before the shuffle, so a query with many rows is no burden
    best = mine.groupBy(*group).agg(F.min_by(
        F.struct(*[c for c in rows.columns if c not in group]), ident).alias("r"))
    return best.select(*group, "r.*").select(*rows.columns)


def at_least(rows: DataFrame, value: str, theta: float) -> DataFrame:
    return rows.where(F.col(value) >= theta)


def drop_uncertain(rows: DataFrame, probability: str, low: float = 0.4,
                   high: float = 0.6) -> DataFrame:
    return rows.where(~F.col(probability).between(low, high))


def gain_band(rows: DataFrame, gain: str, kind: str) -> DataFrame:
    """``clear``: gain > 0.025 or < 0; ``large``/``small``: |gain| over/under 0.05; ``unit``: [-1, 1]."""
    g = F.col(gain)
    keep = {"clear": (g > 0.025) | (g < 0), "large": F.abs(g) > 0.05,
            "small": F.abs(g) <= 0.05, "unit": g.between(-1, 1)}[kind]
    return rows.where(keep)


def scoreable(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Null and NaN features become 0; rows with a feature beyond a 32-bit float are dropped."""
    filled = rows.withColumns({f: F.coalesce(F.nanvl(F.col(f), F.lit(0.0)), F.lit(0.0))
                               for f in features})
    for f in features:
        filled = filled.where(F.abs(F.col(f)) < FLOAT_MAX)
    return filled


def first_of_each(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``; combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*").select(
        *rows.columns)


def random_share(candidates: DataFrame, share: float, group: Sequence[str] = ("query_id",),
                 seed: str = "random") -> DataFrame:
    """``int(share * n)`` candidates of each query in md5 order."""
    placed = hash_order(candidates, list(group), [*group, "candidate_id"], seed=seed)
    return placed.where(F.col("pos") < F.floor(F.col("pos_total") * share)).drop(
        "pos", "pos_total")


def cyclic_time(rows: DataFrame, ts: str) -> DataFrame:
    """Sine and cosine of month, day, hour and weekday, with the periods 24, 12, 12 and 7."""
    parts = {"month": (F.month(ts) - 1, 24), "day": (F.dayofmonth(ts) - 1, 12),
             "hour": (F.hour(ts) - 1, 12), "weekday": (F.weekday(ts), 7)}
    out = rows
    for name, (value, period) in parts.items():
        angle = value * (2 * 3.141592653589793 / period)
        out = out.withColumns({f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)})
    return out


def clean_name(col: str) -> Column:
    """Characters that some learners refuse in a feature name become ``_``."""
    return F.regexp_replace(F.col(col), r"[\[\]<]", "_")
