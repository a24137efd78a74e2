"""Gain/loss labels: global, per query, and by where the sorted gains break off.

All policies read one ordering of each query's candidates. The order is computed by
ranges, so a query with a large part of all candidates is spread over tasks; everything
after it is a partial aggregation per query joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinlift.functions import attach, group_median, materialise, order_of_magnitude, positions

CHUNK = 100_000   # neighbours are looked up in chunks of this many positions
QUERY = ["query_id", "target"]


def label(condition: Column) -> Column:
    return F.when(condition, "gain").otherwise("loss")


def by_threshold(rows: DataFrame, alpha: float = 0.0, gain: str = "gain",
                 out: str = "class_pos_neg") -> DataFrame:
    return rows.withColumn(out, label(F.col(gain) > alpha))


def by_query_average(rows: DataFrame, gain: str = "gain",
                     query: Sequence[str] = QUERY) -> DataFrame:
    """Above the query's mean, and above its median; either also needs a positive gain."""
    g = F.col(gain)
    means = rows.groupBy(*query).agg(F.avg(gain).alias("query_mean"))
    medians = group_median(rows, query, gain, "query_median")
    met = attach(rows, means.join(medians, list(query)), query, ["candidate_id"])
    return met.withColumns({
        "class_mean": label((g > F.col("query_mean")) & (g > 0)),
        "class_median": label((g > F.col("query_median")) & (g > 0))})


def gradients(rows: DataFrame, gain: str = "gain", query: Sequence[str] = QUERY,
              chunk: int = CHUNK, **kw) -> DataFrame:
    """Position ``i`` in ascending gain, gradient to the row before and to the row after.

    The first gradient is minus infinity; the last row has no next gradient.
    """
    placed = positions(rows.where(F.col(gain).isNotNull()), query, [gain, "candidate_id"],
                       pos="i", **kw).withColumnRenamed("i_total", "n")
    # each chunk also sees the row before it and the row after it
    home = F.floor(F.col("i") / chunk)
    seen_in = F.array_distinct(F.array(
        home, F.floor((F.col("i") + 1) / chunk), F.floor((F.col("i") - 1) / chunk)))
    copies = placed.withColumn("__chunk", F.explode(seen_in))
    w = Window.partitionBy(*query, "__chunk").orderBy("i")
    g = F.col(gain)
    step = copies.withColumn("gradient", F.when(F.col("i") == 0, F.lit(float("-inf"))).otherwise(
        g - F.lag(gain).over(w))).withColumn("next_gradient", F.lead("gradient").over(w))
    return step.where(F.col("__chunk") == home).drop("__chunk")


def all_policies(rows: DataFrame, gain: str = "gain", query: Sequence[str] = QUERY,
                 drops: int = 2, **kw) -> DataFrame:
    """Every policy at once: sign, first drop, n-th drop, order of magnitude, median position.

    A drop is met, going down from the best candidate, at a row whose gradient is below the
    gradient of the row above it. Rows at or below the break are losses, as is every
    gain that is not positive.
    """
    graded = materialise(gradients(rows, gain, query, **kw))
    oom = order_of_magnitude(F.col(gain))
    # a row that falls below the row above it; the drop's position is the row's own
    falls = F.col("gradient") < F.col("next_gradient")
    tops = graded.where("i = n - 1").select(*query, oom.alias("top_oom"))
    first = graded.where(falls).groupBy(*query).agg(F.max("i").alias("first_drop"),
                                                    F.count(F.lit(1)).alias("n_drops"))
    # the n-th from the top, or the lowest when there are fewer: top-k keeps few rows per query
    ranked = graded.where(falls).select(*query, "i").withColumn(
        "k", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("i"))))
    nth = ranked.where(F.col("k") <= drops).groupBy(*query).agg(F.min("i").alias("nth_drop"))
    below = attach(graded, tops, query, ["candidate_id"]).where(oom < F.col("top_oom"))
    magnitude = below.groupBy(*query).agg(F.max("i").alias("oom_drop"))
    breaks = tops.join(first, list(query), "left").join(nth, list(query), "left").join(
        magnitude, list(query), "left")
    met = attach(graded, breaks, query, ["candidate_id"])
    g, i = F.col(gain), F.col("i")
    def after(position):
        return label((i > F.coalesce(position, F.lit(-1))) & (g > 0))
    return met.withColumns({
        "class_pos_neg": label(g > 0),
        "harsh_grad_class": after(F.col("first_drop")),
        f"{drops}th_grad_drop_class": after(F.col("nth_drop")),
        "order_of_mag_drop_class": after(F.col("oom_drop")),
        "median_based_class": after(F.ceil(F.col("n") / 2)),
    }).drop("top_oom", "first_drop", "n_drops", "nth_drop", "oom_drop", "next_gradient")
