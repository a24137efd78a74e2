"""Sharding by longest-processing-time scheduling, for groups that must stay together.

Groups are sorted by size, and each goes to the least loaded shard through a heap. Groups of equal size are interchangeable, so
the driver gets one row per distinct size and how many groups have it: fewer than the square root of twice all bytes,
since that many different sizes add up to all bytes. Many groups of one size are handed out up to a common level of
load at once, which gives the counts that one by one would. Groups are numbered within their size, and the number names the shard.

Positions, of groups within a size and of rows within a shard, come from counts per slice and a rank within the slice; slices
follow the number of rows, and a row repeated beyond a slice is dealt over slices, so no task ranks a whole shard.

Defined cases: a null text counts as an empty one and groups with it. Repeated rows stay together
and take different positions. An empty table gives an empty result; with fewer groups than shards, some shards are empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinlift.llm.common import lookup_join, store

SHARDS = 40
OVERHEAD = 16              # bytes of a row besides its text
SLICE_ROWS = 20_000


def schedule(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Longest first, each to the least loaded shard; ties by name and by shard number."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _raise(heap: list[tuple[int, int]], size: int, count: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """The heap after most of ``count`` items, and the items per shard: all that start below the highest level they suffice for."""
    def starts(load: int, level: int) -> int:
        return max(0, -((load - level) // size))
    low, high = heap[0][0], heap[0][0] + size * count + 1          # enough at the one, too few at the other
    while high - low > 1:
        level = (low + high) // 2
        if sum(starts(load, level) for load, _ in heap) <= count:
            low = level
        else:
            high = level
    given = {shard: starts(load, low) for load, shard in heap}
    raised = [(load + size * given[shard], shard) for load, shard in heap]
    heapq.heapify(raised)
    return raised, {s: n for s, n in given.items() if n}


def hand_out(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, dict[int, int]]]:
    """Per (size, count), by falling size: how many of its items each shard gets, as ``schedule`` would place them."""
    heap = [(0, s) for s in range(shards)]
    for size, count in sizes:
        if not size:                                                # adds no load: the least loaded shard stays the least loaded
            yield size, {heap[0][1]: count}
            continue
        given: dict[int, int] = {}
        left = count
        if count > shards:
            heap, given = _raise(heap, size, count)
            left -= sum(given.values())                             # fewer than the shards: those that start at the level itself
        for _ in range(left):
            load, shard = heap[0]
            given[shard] = given.get(shard, 0) + 1
            heapq.heapreplace(heap, (load + size, shard))
        yield size, given


def numbered(rows: DataFrame, n: int, by: str, order: list[str], out: str, extra: str | None = None) -> DataFrame:
    """Adds ``out``: a gapless position within ``by``, from 0. ``rows`` must be stored; ``n`` is their number.

    Rows fall into slices by a hash of ``order``, and of the column ``extra`` where given.
    """
    slices = max(1, -(-n // SLICE_ROWS))
    sliced = rows.withColumn("__slice", F.pmod(F.xxhash64(*order, *([extra] if extra else [])), F.lit(slices)))
    counts = sliced.groupBy(by, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(by, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(by, "__slice").orderBy(*order)) - 1
    return (sliced.withColumn("__rank", rank).join(counts, [by, "__slice"])
            .withColumn(out, (F.col("__before") + F.col("__rank")).cast("long")).drop("__slice", "__before", "__rank"))


def assign(rows: DataFrame, size: str, group: str, shards: int = SHARDS) -> DataFrame:
    """Adds ``shard`` and ``__rows`` (rows of the group) to stored rows: equal groups share one shard, and the sums of sizes come out near equal."""
    spark = rows.sparkSession
    groups = store(rows.groupBy(F.col(group).alias("__group")).agg(F.sum(size).alias("__bytes"), F.count(F.lit(1)).alias("__rows")))
    sizes = store(groups.groupBy("__bytes").agg(F.count(F.lit(1)).alias("__count")))
    table = sizes.toArrow().sort_by([("__bytes", "descending")])
    counts = table.column("__count").to_numpy()
    placed = list(hand_out(zip(table.column("__bytes").to_numpy().tolist(), counts.tolist()), shards))
    ends = pa.array([[sum(list(g.values())[:i + 1]) for i in range(len(g))] for _, g in placed], pa.list_(pa.int64()))
    names = pa.array([list(g) for _, g in placed], pa.list_(pa.int32()))
    by_size = store(spark.createDataFrame(pa.table(
        {"__bytes": pa.array([s for s, _ in placed], pa.int64()), "__count": pa.array(counts, pa.int64()), "__ends": ends, "__names": names})))
    at = store(numbered(groups, groups.count(), "__bytes", ["__group"], "__number"))
    at = lookup_join(at, by_size, "__bytes", "__count")
    passed = F.size(F.filter("__ends", lambda e: e <= F.col("__number")))
    at = store(at.select("__group", "__rows", F.get("__names", passed).alias("shard")))
    # the rows of a group are its weight as a key
    return lookup_join(rows.withColumn("__group", F.col(group)), at.withColumn("__weight", F.col("__rows")), "__group", "__weight").drop("__group")


def with_slots(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Adds ``slot``: a gapless position within the shard, from 0. ``rows`` must be stored, as ``assign`` returns them; ``n`` is their number."""
    many = rows.where(F.col("__rows") > SLICE_ROWS).groupBy(*order).agg(F.count(F.lit(1)).alias("__copies")).where(
        F.col("__copies") > SLICE_ROWS)
    key = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]))
    many = store(many.select(key.alias("__key"), "__copies", F.lit(True).alias("__many")))
    if many.isEmpty():
        return numbered(rows.drop("__rows"), n, "shard", order, "slot")
    # copies of one row are alike, so any numbering of them is the same result
    own = lookup_join(rows.withColumns({"__key": key, "__id": F.monotonically_increasing_id()}), many, "__key", "__copies")
    own = store(own.select(*[c for c in rows.columns if c != "__rows"], F.when(F.col("__many"), F.col("__id")).alias("__copy")))
    return numbered(own, n, "shard", order, "slot", "__copy").drop("__copy")


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; rows of equal text are in one shard."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = store(docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
                             F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("text_md5")))
    placed = store(assign(rows, "size", "text_md5", shards))
    return with_slots(placed, placed.count(), ["doc_id", "text_md5"]).select(
        "doc_id", "size", "text_crc32", "shard", "slot")
