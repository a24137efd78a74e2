"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. Words are summed by source and hash bucket; the bucket in which a source's budget runs out
is found from running sums, and only its documents are summed again in finer buckets, level by level, until one
hash is left. A document is taken when its hash is below its source's threshold: no sort, and reruns agree.
A target above the source's size takes every document a whole number of times, and the rest by threshold.

Defined cases: a null text has size 0; the null source is a source of its own, last in order. Rows that are equal in id
and text share a hash and are taken together. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinlift.llm.common import lookup_join, store

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
LEVELS = (12, 12, 12, 12)      # bits of the hash that each level of buckets adds
HASH_BITS = sum(LEVELS)


def size_of(text: Column) -> Column:
    """Number of words: runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hash_of(key: Column, text: Column) -> Column:
    """The first 48 bits of md5(id | md5(text))."""
    parts = F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(parts), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, source_size): shares of all sizes by weight, none above its cap.

    Sources in order of cap per weight are capped one after the other for as long as an equal share of what is left
    would exceed the cap; this is where resharing the excess again and again ends. One row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = ranked.withColumns({
        "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "rest_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    capped = F.col("cap") * F.col("rest_weight") < F.col("rest") * F.col("weight")
    # the first source that isn't capped fixes the share of all after it
    left = left.withColumn("share", F.when(~capped, F.col("rest") / F.col("rest_weight")))
    share = F.first("share", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return left.withColumn("share", share).withColumn(
        "target", F.coalesce(F.col("weight") * F.col("share"), F.col("cap").cast("double"))).select(
        "source", "source_size", "weight", F.least("target", F.col("cap").cast("double")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, below): documents whose hash is below the threshold come to about the budget of their source.

    ``rows``: stored (skey, size, hash); ``budgets``: (skey, n, budget). Each level keeps the rows of one
    bucket per source, so it is smaller by the number of buckets; the last one decides for a single hash.
    """
    state = store(budgets.select("skey", "n", F.col("budget").alias("left"), F.lit(0).cast("long").alias("bucket")))
    done = 0
    for bits in LEVELS:
        prefix = F.shiftright("hash", HASH_BITS - done)
        finer = F.shiftright("hash", HASH_BITS - done - bits)
        inside = lookup_join(rows, state, "skey", "n").where(prefix == F.col("bucket"))
        sums = inside.groupBy("skey", finer.alias("fine")).agg(F.sum("size").alias("words"))
        joined = sums.join(state.select("skey", "left"), "skey")
        running = F.sum("words").over(Window.partitionBy("skey").orderBy("fine"))
        upto = joined.withColumn("upto", running)
        edge = upto.where(F.col("upto") > F.col("left")).groupBy("skey").agg(
            F.min_by(F.struct("fine", "upto", "words"), "fine").alias("e"))
        rest = state.join(edge, "skey", "left")
        state = store(rest.select(
            "skey", "n", F.when(F.col("e").isNotNull(), F.col("left") - (F.col("e.upto") - F.col("e.words"))).otherwise(0.0).alias("left"),
            F.coalesce(F.col("e.fine"), F.shiftleft(F.col("bucket") + 1, bits)).alias("bucket"), F.col("e.words").alias("words")))
        done += bits
    nearer = F.coalesce(F.col("words") - F.col("left") < F.col("left"), F.lit(False))     # taking the boundary hash or not
    return state.select("skey", "n", (F.col("bucket") + F.when(nearer, 1).otherwise(0)).alias("below"))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, skey, size, hash), and stored per source (skey, n, source_size, target, times, below)."""
    rows = store(docs.select(
        F.col(key).alias("doc_id"), F.struct(F.col(source).cast("string").alias("source")).alias("skey"),
        size_of(F.col(text)).alias("size"), hash_of(F.col(key), F.col(text)).alias("hash")))
    sizes = store(rows.groupBy("skey").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")).withColumn(
        "source", F.col("skey.source")))
    want = targets(sizes.select("source", "source_size"))
    want = sizes.drop("source_size").join(want, sizes["source"].eqNullSafe(want["source"])).drop("source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    times = F.least(F.floor(ratio), F.lit(MOST_TIMES)).cast("int")
    want = store(want.withColumn("times", times).withColumn(
        "budget", F.greatest(F.col("target") - F.col("times") * F.col("source_size"), F.lit(0.0))))
    cut = thresholds(rows, want.select("skey", "n", "budget"))
    return rows, store(want.join(cut.drop("n"), "skey"))


def _times() -> Column:
    return F.col("times") + F.when((F.col("hash") < F.col("below")) & (F.col("times") < MOST_TIMES), 1).otherwise(0)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    rows, per_source = plan(docs, key, text, source)
    joined = lookup_join(rows, per_source.drop("budget"), "skey", "n")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def repeat(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken."""
    _, per_source = plan(docs, key, text, source)
    keyed = docs.withColumns({"__skey": F.struct(F.col(source).cast("string").alias("source")),
                              "__hash": hash_of(F.col(key), F.col(text))})
    table = store(per_source.select(F.col("skey").alias("__skey"), "n", F.struct("times", "below").alias("__cut")))
    joined = lookup_join(keyed, table, "__skey", "n")
    below = (F.col("__hash") < F.col("__cut.below")) & (F.col("__cut.times") < MOST_TIMES)
    times = F.col("__cut.times") + F.when(below, 1).otherwise(0)
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)
