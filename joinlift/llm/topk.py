"""Exact top-k by inner product: tiled matrix products, partial selection per tile, and tree merging of the lists.

The table is dealt into shards of about ``SHARD_ROWS`` vectors by a hash of their id. Each shard meets the queries in
tiles of ``QUERY_ROWS``; a tile's matrix product keeps the best k of each query by partial selection. Lists of a
query are then merged ``FAN`` shards at a time until one is left, so no task gathers all lists of a query at once.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part; vectors of another length
than the query score only against those of equal length. Ties go to the smaller id. Rows repeated under one id count once, by
their smallest vector (``one_per_id``). No queries or no other rows: no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS = 8_192
QUERY_ROWS = 512
FAN = 16
EXACT = 2.0 ** 52          # sums of integers below this are exact in double precision
TOO_LONG = 2.0 ** 62


def usable(vector: Column) -> Column:
    """Not null, not empty, every component a finite number."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False))


def one_per_id(table: DataFrame, key: str, vector: Column) -> DataFrame:
    """(vec_id, v): the smallest vector of each id."""
    return table.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("vec_id")).agg(F.min(vector).alias("v"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k: highest score first, ties by smaller id. -inf is no candidate."""
    at = np.flatnonzero(scores > -np.inf)
    if len(at) > k:
        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= kth]                      # all ties of the last place, to choose by id
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def merge_lists(lists: DataFrame, groups: int, k: int, fan: int = FAN) -> DataFrame:
    """(query_id, vec_id, score, grp) rows to the best k per query, ``fan`` groups at a time."""
    while True:
        groups = -(-groups // fan)
        by = ["query_id"] if groups <= 1 else ["query_id", "grp"]
        lists = lists.withColumn("grp", F.floor(F.col("grp") / fan).cast("int"))
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
        lists = lists.withColumn("rank", rank).where(F.col("rank") <= k)
        if groups <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def tile_lists(vectors: DataFrame, queries: DataFrame, k: int, shards: int, kind: str) -> DataFrame:
    """The best k of each query within each shard. ``vectors``: (vec_id, v), ``queries``: (query_id, q); v and q arrays of numbers."""
    dealt = vectors.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    sent = queries.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(left) or not len(right):
            return
        for out in best_in_tiles(left.to_pandas(), right.to_pandas(), k, kind == "long"):
            yield out.cast(schema)

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()),
                        ("score", pa.int64() if kind == "long" else pa.float64()), ("grp", pa.int32())])
    return sent.groupBy("grp").cogroup(dealt.groupBy("grp")).applyInArrow(
        lambda q, v: pa.Table.from_batches(list(search(q, v)), schema), f"query_id long, vec_id long, score {kind}, grp int")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products; those of integers are exact: in double precision where no sum can leave it, else in 64-bit integers."""
    fq, fx = q.astype(np.float64, copy=False), x.astype(np.float64, copy=False)
    if q.dtype == np.int64 and np.sqrt((fq ** 2).sum(axis=1).max() * (fx ** 2).sum(axis=1).max()) >= EXACT:
        return q @ x.T
    return fq @ fx.T


def best_in_tiles(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, whole: bool) -> Iterator[pa.RecordBatch]:
    grp, kind = int(vectors["grp"].iloc[0]), np.int64 if whole else np.float64
    for width, same in vectors.groupby(vectors["v"].map(len)):
        fitting = queries[queries["q"].map(len) == width]
        x, ids = np.array(same["v"].tolist(), kind), same["vec_id"].to_numpy(np.int64)
        for start in range(0, len(fitting), QUERY_ROWS):
            some = fitting.iloc[start:start + QUERY_ROWS]
            own = some["query_id"].to_numpy(np.int64)
            scores = products(np.array(some["q"].tolist(), kind), x)
            others = [np.flatnonzero(ids != i) for i in own]
            found = [o[select(row[o], ids[o], k)] for o, row in zip(others, scores)]
            n = [len(f) for f in found]
            at = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, n)), pa.array(ids[at]), pa.array(scores[np.repeat(np.arange(len(own)), n), at]),
                 pa.array(np.full(len(at), grp, np.int32))], ["query_id", "vec_id", "score", "grp"])


def search_integers(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the exact best k by integer inner product.

    Vectors whose squared length is ``TOO_LONG`` or more take no part, as their scores need not fit a long.
    """
    def short(v: str) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) < TOO_LONG
    vectors, queries = vectors.where(short("v")), queries.where(short("q"))
    shards = max(1, -(-vectors.count() // shard_rows))
    lists = tile_lists(vectors, queries, k, shards, "long")
    return merge_lists(lists, shards, k)
