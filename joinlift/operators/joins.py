"""Augmentation joins, key containment and the pairing of queries with foreign candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlift.functions import attach, finite, hash32, materialise, meet, positions
from joinlift.schema import PAIR

PQ = ["query_id", "candidate_id"]
BLOCK_ROWS = 10_000      # base rows that meet the list of columns in one block


def keys_of(cells: DataFrame) -> DataFrame:
    """Distinct keys per dataset; map-side partial aggregation carries the load."""
    return cells.select("dataset_id", "row_key").distinct()


def with_row_id(cells: DataFrame) -> DataFrame:
    """Cells with ``row_id``: what tells a base's rows apart where its key repeats; the key itself where none is given."""
    return cells if "row_id" in cells.columns else cells.withColumn("row_id", F.col("row_key"))


def augmentation_join(pairs: DataFrame, cells: DataFrame, how: str = "left") -> DataFrame:
    """Join each query with its candidate in cell form.

    Gives ``(query_id, candidate_id, row_key, side, col, v)``: the query's own cells and, per
    query row, the candidate's. A query's key may repeat: cells that carry ``row_id`` keep each of its rows, and
    the result has that column too. Names cannot clash because ``side`` tells them apart. ``inner``
    keeps only the rows on which every value is present.
    """
    row = ["row_id", "row_key"] if "row_id" in cells.columns else ["row_key"]
    ids = materialise(pairs.select(*PQ).distinct())
    q = meet(cells.withColumnRenamed("dataset_id", "query_id"), ids, ["query_id"], row)
    q_cells = q.select(*PQ, *row, F.lit("query").alias("side"), "col", "v")
    c = meet(cells.withColumnRenamed("dataset_id", "candidate_id"), ids, ["candidate_id"], ["row_key"])
    q_rows = q.select(*PQ, *row).distinct()
    c_cols = c.select(*PQ, "col").distinct()
    frame = attach(q_rows, c_cols, PQ, row, how="inner")
    c_cells = frame.join(c.select(*PQ, "row_key", "col", "v"), [*PQ, "row_key", "col"], "left") \
        .select(*PQ, *row, F.lit("candidate").alias("side"), "col", "v")
    joined = q_cells.unionByName(c_cells)
    if how == "left":
        return joined
    broken = joined.where(F.col("v").isNull()).select(*PQ, row[0]).distinct()
    return joined.join(broken, [*PQ, row[0]], "left_anti")


def unique_key_candidates(cells: DataFrame) -> DataFrame:
    """Datasets whose key repeats in no column: those that may take part in an m:1 join."""
    # the count of one key is a small number; its maximum decides for the dataset
    repeats = cells.groupBy("dataset_id", "col", "row_key").agg(F.count(F.lit(1)).alias("c"))
    return repeats.groupBy("dataset_id").agg(F.max("c").alias("c")).where("c = 1").select(
        "dataset_id")


def many_candidate_join(base_id: str, candidates: DataFrame, cells: DataFrame) -> DataFrame:
    """One base with all its candidates in a single join, mean-imputed, as cells.

    The base's key may repeat (``row_id`` in ``cells`` keeps its rows apart, and is kept). Candidates
    with a repeated key are skipped; infinities and NaN count as missing; means are those of the joined rows,
    and a column without any match becomes 0. ``candidates`` holds ``candidate_id``.
    """
    row = ["row_id", "row_key"] if "row_id" in cells.columns else ["row_key"]
    clean = cells.withColumn("v", finite(F.col("v")))
    base = clean.where(F.col("dataset_id") == base_id)
    rows = materialise(base.select(*row).distinct())
    mine = clean.join(candidates.select(F.col("candidate_id").alias("dataset_id")), "dataset_id",
                      "left_semi").select("dataset_id", "row_key", "col", "v")
    mine = materialise(mine.join(unique_key_candidates(mine), "dataset_id", "left_semi"))
    matched = rows.join(mine, "row_key")
    wanted = mine.select("dataset_id", "col").distinct()
    means = matched.groupBy("dataset_id", "col").agg(F.avg("v").alias("m"))
    # every row needs every column: rows go out in blocks, whose number follows the rows, and each meets the list of columns
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    wanted = wanted.join(means, ["dataset_id", "col"], "left").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    frame = rows.withColumn("block", F.pmod(F.xxhash64(row[0]), F.lit(blocks)).cast("int")).join(
        wanted, "block").drop("block")
    filled = frame.join(mine, ["dataset_id", "row_key", "col"], "left").select(
        F.col("dataset_id").alias("candidate_id"), *row, "col",
        F.coalesce("v", "m", F.lit(0.0)).alias("v"))
    base_means = base.groupBy("col").agg(F.avg("v").alias("m"))
    base_filled = base.join(base_means, "col").select(
        F.lit(base_id).alias("candidate_id"), *row, "col",
        F.coalesce("v", "m", F.lit(0.0)).alias("v"))
    return base_filled.unionByName(filled)


def to_wide(joined: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pivot the joined cells of one base into a table, one line per base row; only for the few that survive.

    A column is named ``dataset/column``, so names cannot clash, unless ``joined`` gives a ``name``.
    """
    row = ["row_id", "row_key"] if "row_id" in joined.columns else ["row_key"]
    name = F.col("name") if "name" in joined.columns else F.concat_ws("/", "candidate_id", "col")
    named = joined.select(*row, name.alias("name"), "v")
    return named.groupBy(*row).pivot("name", columns).agg(F.first("v"))


def containment(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Share of the query's keys that the candidate also has, per pair."""
    ids = materialise(pairs.select(*PQ).distinct())
    keys = materialise(keys_of(cells))
    sizes = keys.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    q = meet(keys.withColumnRenamed("dataset_id", "query_id"), ids, ["query_id"], ["row_key"])
    common = (q.join(keys.withColumnRenamed("dataset_id", "candidate_id"),
                     ["candidate_id", "row_key"])
              .groupBy(*PQ).agg(F.count(F.lit(1)).alias("n_common")))
    return (ids.join(sizes.select(F.col("dataset_id").alias("query_id"),
                                  F.col("n").alias("n_query_keys")), "query_id")
            .join(sizes.select(F.col("dataset_id").alias("candidate_id"),
                               F.col("n").alias("n_candidate_keys")), "candidate_id")
            .join(common, PQ, "left")
            .select(*PQ, "n_query_keys", "n_candidate_keys",
                    F.coalesce("n_common", F.lit(0)).alias("n_common"))
            .withColumn("containment", F.col("n_common") / F.col("n_query_keys")))


def containment_of_joined(joined: DataFrame) -> DataFrame:
    """Containment read off a finished left join: share of rows with any candidate value."""
    per_row = joined.groupBy(*PQ, "row_key").agg(
        F.max(F.when((F.col("side") == "candidate") & F.col("v").isNotNull(), 1)
              .otherwise(0)).alias("hit"))
    return per_row.groupBy(*PQ).agg(F.avg("hit").alias("containment"))


def overlap(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Intersection against both sides, and which side is larger."""
    both = containment(pairs, cells)
    return both.select(
        "*", (F.col("n_common") / F.col("n_candidate_keys")).alias("candidate_containment"),
        (F.col("n_candidate_keys") > F.col("n_query_keys")).alias("candidate_is_larger"))


def discover(query_ids: DataFrame, cells: DataFrame, theta: float) -> DataFrame:
    """All datasets that contain at least ``theta`` of a query's keys.

    Exact, without meeting the lake on common keys: a dataset that reaches theta must hold
    one of the query's ``n - ceil(theta*n) + 1`` rarest keys, so only those are looked up;
    the short list is then checked on all keys.
    """
    if not 0 < theta <= 1:
        raise ValueError("theta must be in (0, 1]; at 0 every dataset qualifies")
    keys = materialise(keys_of(cells))
    frequency = keys.groupBy("row_key").agg(F.count(F.lit(1)).alias("f"))
    mine = keys.join(query_ids.select(F.col("query_id").alias("dataset_id")), "dataset_id",
                     "left_semi").join(frequency, "row_key")
    # a slack far below one key guards against theta*n falling just above a whole number
    need = F.ceil(F.lit(theta) * F.col("pos_total") - 1e-9)
    rare = positions(mine, ["dataset_id"], ["f", "row_key"]).where(
        F.col("pos") < F.col("pos_total") - need + 1)
    short = rare.select(F.col("dataset_id").alias("query_id"), "row_key").join(
        keys.withColumnRenamed("dataset_id", "candidate_id"), "row_key").where(
        "query_id <> candidate_id").select(*PQ).distinct()
    return containment(short, cells).where(F.col("containment") >= theta)


def key_gate(cells: DataFrame) -> DataFrame:
    """Whether a dataset's key is unique, else it would need an aggregation first."""
    per_key = cells.groupBy("dataset_id", "col", "row_key").agg(F.count(F.lit(1)).alias("c"))
    return per_key.groupBy("dataset_id").agg((F.max("c") == 1).alias("key_is_unique"))


def negative_pairs(datasets: DataFrame, max_columns: int, per_query: int,
                   seed: str = "negatives") -> DataFrame:
    """Pair each query with up to ``per_query`` candidates of other sources.

    ``datasets``: ``(source, query_id, candidate_id, n_query_cols, n_candidate_cols)``. A candidate is
    allowed when the two column counts stay within ``max_columns``. All allowed candidates
    are equally likely, yet no product of queries and candidates is formed: candidates are
    numbered by (columns, source), so the allowed ones form a prefix with a few gaps (the
    query's own source), and evenly spaced numbers from a hashed start are looked up.
    """
    cands = datasets.select(
        "candidate_id", F.col("source").alias("c_source"), F.col("n_candidate_cols").alias("w"),
        F.md5("source").alias("h")).where(F.col("w") < max_columns).distinct()
    numbered = materialise(positions(cands, [], ["w", "h", "candidate_id"], pos="at").drop(
        "at_total"))
    # one row per column count: where the prefix of that width ends
    widths = numbered.groupBy("w").agg((F.max("at") + 1).alias("prefix_end"))
    # the runs of one source, one per column count
    runs = numbered.groupBy(F.col("c_source").alias("source"), "w").agg(
        F.min("at").alias("a"), F.count(F.lit(1)).alias("len"))
    queries = datasets.select("source", "query_id", "n_query_cols").distinct().withColumn(
        "budget", F.lit(max_columns) - F.col("n_query_cols"))
    # at most max_columns budgets, each with at most as many widths
    ends = (queries.where("budget >= 1").select("budget").distinct()
            .withColumn("w", F.explode(F.sequence(F.lit(1), "budget")))
            .join(widths, "w").groupBy("budget").agg(F.max("prefix_end").alias("end")))
    own = runs.groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("a", "len", "w"))).alias("runs"))
    q = queries.join(ends, "budget").join(own, "source", "left")
    gaps = F.filter(F.coalesce("runs", F.array()), lambda r: r["w"] <= F.col("budget"))
    q = q.withColumn("gaps", gaps).withColumn(
        "available", F.col("end") - F.aggregate("gaps", F.lit(0).cast("long"),
                                                lambda s, r: s + r["len"]))
    q = q.where(F.col("available") > 0).withColumn(
        "take", F.least(F.lit(per_query).cast("long"), "available"))
    start = F.pmod(hash32("query_id", seed=seed), F.col("available"))
    drawn = q.withColumn("start", start).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)))
    nth = F.pmod(F.col("start") + F.floor(F.col("i") * F.col("available") / F.col("take")),
                 F.col("available"))
    # step over the gaps that lie at or before the number drawn
    drawn = drawn.withColumn("nth", nth).withColumn("at", F.aggregate(
        "gaps", F.col("nth"), lambda at, r: F.when(r["a"] <= at, at + r["len"]).otherwise(at)))
    return drawn.join(numbered, "at").select("query_id", "candidate_id", "source", "c_source",
                                             "available")


def positional_rekey(pairs: DataFrame, cells: DataFrame, order: str = "row_ord") -> DataFrame:
    """Give the i-th row of a candidate the i-th key of the query; extra rows get new keys.

    ``cells`` carries ``row_ord``, the row's place at ingest. The result is a set of new candidates
    ``<candidate>@<query>``.
    """
    rows = cells.groupBy("dataset_id", "row_key").agg(F.min(order).alias(order))
    placed = materialise(positions(rows, ["dataset_id"], [order, "row_key"]))
    ids = materialise(pairs.select(*PQ).distinct())
    q = meet(placed.select(F.col("dataset_id").alias("query_id"), "pos", F.col("row_key").alias("new_key")), ids, ["query_id"], ["pos"])
    c = meet(placed.select(F.col("dataset_id").alias("candidate_id"), "pos", "row_key"), ids, ["candidate_id"], ["pos"])
    mapped = c.join(q, [*PQ, "pos"], "left").select(
        *PQ, "row_key",
        F.coalesce("new_key", F.concat(F.lit("x-"), F.col("pos").cast("string"))).alias("new_key"))
    moved = mapped.join(cells.withColumnRenamed("dataset_id", "candidate_id"),
                        ["candidate_id", "row_key"])
    return moved.select(*PQ, F.concat_ws("@", "candidate_id", "query_id").alias("dataset_id"),
                        F.col("new_key").alias("row_key"), "col", "v")


def effective_single_columns(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Split candidates into one per column and keep those whose join has any value."""
    ids = materialise(pairs.select(*PQ).distinct())
    q = meet(keys_of(cells).withColumnRenamed("dataset_id", "query_id"), ids, ["query_id"], ["row_key"])
    c = meet(cells.withColumnRenamed("dataset_id", "candidate_id"), ids, ["candidate_id"], ["row_key"])
    hit = q.join(c, [*PQ, "row_key"]).groupBy(*PQ, "col").agg(F.count("v").alias("n_joined"))
    return hit.where("n_joined > 0").select(
        "query_id", F.concat_ws("/", "candidate_id", "col").alias("candidate_id"), "n_joined")


def single_column_cells(cells: DataFrame) -> DataFrame:
    """Every column as a dataset of its own: ``dataset/col``."""
    return cells.withColumn("dataset_id", F.concat_ws("/", "dataset_id", "col"))


def label_tables(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Merge label columns of the same (query, candidate)."""
    return left.join(right, PQ, how)


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that two corpora have in common."""
    return left.select(key).intersect(right.select(key))


def pair_cells(pairs: DataFrame, cells: DataFrame, side: str) -> DataFrame:
    """The cells behind one side of every pair (``query`` or ``candidate``)."""
    ident, names = f"{side}_id", [c for c in PAIR if c in pairs.columns]
    return meet(cells.withColumnRenamed("dataset_id", ident), materialise(pairs.select(*names)), [ident], ["row_key"]).select(
        *names, "row_key", "col", "v")
