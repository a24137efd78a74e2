"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

Each half of a vector is quantised by a codebook of its own (fitted by k-means on a bounded sample), so every vector lies in
a cell named by a pair of centroids. A query traverses the pairs by summed score with a heap until the cells hold
a share of all vectors; all entries of the visited cells are reranked by their exact score. The share is the least of ``SHARES`` by which
``TRIAL_QUERIES`` vectors of the sample find ``RECALL`` of their exact neighbours within the sample; the same rule holds at every size.

The index deals cells over groups of about ``GROUP_ROWS`` vectors; a cell with more than one group's share is split by a hash
of its vectors, so a vector that a third of all rows repeat is spread as well. A query is sent to the groups with
the score at which its traversal ended, which names the visited cells exactly.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component takes no part. All
vectors must have one length; others than the most common one take no part. Ties go to the smaller id. Rows repeated under
one id count once, by their smallest vector.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlift.llm.common import store
from joinlift.llm.topk import matrix, merge_lists, select, usable

SAMPLE_ROWS = 20_000       # vectors that the codebooks are fitted on, at most
MOST_CENTROIDS = 64        # per half
KMEANS_ROUNDS = 8
SHARES = (0.02, 0.05, *(i / 10 for i in range(1, 11)))
TRIAL_QUERIES = 512
RECALL = 0.95              # asked for within the sample; among more vectors the nearest are nearer, so more are found
GROUP_ROWS = 8_192


def kmeans(x: np.ndarray, k: int, rounds: int = KMEANS_ROUNDS) -> np.ndarray:
    """Centroids of the distinct rows of ``x``; at most k."""
    distinct = np.unique(x, axis=0)
    pick = np.random.default_rng(7).permutation(len(distinct))[:k]
    centroids = distinct[np.sort(pick)]
    for _ in range(rounds):
        near = assign(x, centroids)
        n = np.bincount(near, minlength=len(centroids))
        sums = np.stack([np.bincount(near, x[:, j], len(centroids)) for j in range(x.shape[1])], axis=1)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def assign(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids ** 2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, want: int) -> float:
    """The summed score of the last pair visited: pairs come off a heap by falling sum until they hold ``want`` vectors."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    sa, sb = first[a].tolist(), second[b].tolist()
    held = sizes[np.ix_(a, b)].tolist()
    heap = [(-(sa[0] + sb[0]), 0, 0)]
    seen = 0
    least = np.inf
    while heap:
        least, i, j = heapq.heappop(heap)
        seen += held[i][j]
        if seen >= want:
            break
        if j + 1 < len(sb):
            heapq.heappush(heap, (-(sa[i] + sb[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(sa):
            heapq.heappush(heap, (-(sa[i + 1] + sb[0]), i + 1, 0))
    return -least


def visits_needed(x: np.ndarray, first: np.ndarray, second: np.ndarray, k: int, queries: int = TRIAL_QUERIES) -> np.ndarray:
    """For each of the exact best k of some rows of ``x`` among all others: the share of rows in the cells visited before its own."""
    half = first.shape[1]
    cells = assign(x[:, :half], first) * len(second) + assign(x[:, half:], second)
    sizes = np.bincount(cells, minlength=len(first) * len(second))
    needed = []
    for at in np.unique(np.linspace(0, len(x) - 1, queries).astype(int)):
        q = x[at]
        scores = x @ q
        scores[at] = -np.inf
        near = select(scores, np.arange(len(x)), min(k, len(x) - 1))
        order = np.argsort(-((first @ q[:half])[:, None] + (second @ q[half:])[None, :]).ravel(), kind="stable")
        before = np.empty(len(sizes), np.int64)
        before[order] = np.cumsum(sizes[order]) - sizes[order]
        needed.append(before[cells[near]] / len(x))
    return np.concatenate(needed)


def least_share(x: np.ndarray, first: np.ndarray, second: np.ndarray, k: int, recall: float = RECALL) -> float:
    """The least of ``SHARES`` that finds this part of the exact neighbours within ``x``."""
    needed = visits_needed(x, first, second, k)
    return next((s for s in SHARES if not len(needed) or (needed < s).mean() >= recall), 1.0)


def _search(queries: pd.DataFrame, entries: pd.DataFrame, first: np.ndarray, second: np.ndarray, k: int) -> pd.DataFrame:
    """The best k of each query among the entries of one group whose cells it visits."""
    entries = entries.sort_values(["cell", "vec_id"], kind="stable")
    x, ids, cells = matrix(entries["v"]), entries["vec_id"].to_numpy(np.int64), entries["cell"].to_numpy()
    names, starts = np.unique(cells, return_index=True)
    ends = np.append(starts[1:], len(cells))
    half = first.shape[1]
    out = []
    for at in range(0, len(queries), 512):
        some = queries.iloc[at:at + 512]
        q, own, last = matrix(some["v"]), some["vec_id"].to_numpy(np.int64), some["last"].to_numpy()
        pair = (q[:, :half] @ first.T)[:, names // len(second)] + (q[:, half:] @ second.T)[:, names % len(second)]
        visits = pair >= last[:, None] - 1e-9
        scores = np.full((len(some), len(x)), -np.inf)
        for c in range(len(names)):
            who = np.flatnonzero(visits[:, c])
            if len(who):
                scores[who, starts[c]:ends[c]] = q[who] @ x[starts[c]:ends[c]].T
        scores[own[:, None] == ids[None, :]] = -np.inf
        for r in range(len(some)):
            # a few more than k by the matrix product, then exact sums that don't depend on a row's place
            row = scores[r]
            near = np.flatnonzero(row > -np.inf)
            if len(near) > k:
                near = near[row[near] >= np.partition(row[near], len(near) - k)[len(near) - k] - 1e-9]
            exact = (x[near] * q[r]).sum(axis=1)
            best = select(exact, ids[near], k)
            out.append((np.full(len(best), own[r]), ids[near][best], exact[best]))
    grp = int(entries["grp"].iloc[0])
    cols = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
    return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]}).assign(grp=grp)


def search(table: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding",
           visit_share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the best k found for each row that ``is_query`` names, among all rows but its own.

    ``visit_share``: the share of vectors to visit; none: as measured (``least_share``).
    """
    spark = table.sparkSession
    v = F.col(vector).cast("array<double>")
    zero = F.forall(v, lambda x: x == 0.0)
    rows = table.where(F.col(key).isNotNull() & usable(F.col(vector)) & ~zero).groupBy(
        F.col(key).cast("long").alias("vec_id")).agg(F.min(v).alias("v"))
    rows = store(rows)
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if widths is None:
        return empty
    width, n = widths
    rows = rows.where(F.size("v") == width)
    half = max(1, width // 2)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
    x = matrix(sample["v"])
    k_half = int(min(MOST_CENTROIDS, max(1, np.sqrt(n))))
    first, second = kmeans(x[:, :half], k_half), kmeans(x[:, half:], k_half) if width > 1 else np.zeros((1, 0))
    k2 = len(second)

    def quantise(batches):
        for batch in batches:
            y = matrix(pd.Series(batch.column(1).to_pylist())).reshape(batch.num_rows, width)
            cell = assign(y[:, :half], first) * k2 + assign(y[:, half:], second)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["vec_id", "v", "cell"])

    index = store(rows.mapInArrow(quantise, "vec_id long, v array<double>, cell int"))
    sizes = np.zeros((len(first), k2), np.int64)
    for cell, count in index.groupBy("cell").count().collect():             # at most MOST_CENTROIDS squared rows
        sizes[cell // k2, cell % k2] = count
    want = int(np.ceil((least_share(x, first, second, k) if visit_share is None else visit_share) * n))
    groups = max(1, -(-n // GROUP_ROWS))
    # a cell larger than half a group is dealt out by its vectors
    wide = {int(c): int(-(-2 * s // GROUP_ROWS)) for c, s in enumerate(sizes.ravel()) if 2 * s > GROUP_ROWS}
    spread = F.lit(1)
    if wide:
        spread = F.coalesce(F.try_element_at(F.create_map(*[F.lit(i) for kv in wide.items() for i in kv]), F.col("cell")), F.lit(1))
    piece = F.pmod(F.xxhash64("vec_id"), spread)
    dealt = index.withColumn("grp", F.pmod(F.xxhash64("cell", piece), F.lit(groups)).cast("int"))

    def end_of_traversal(batches):
        for batch in batches:
            q = matrix(pd.Series(batch.column(1).to_pylist())).reshape(batch.num_rows, width)
            last = [traverse(a, b, sizes, want) for a, b in zip(q[:, :half] @ first.T, q[:, half:] @ second.T)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(last, pa.float64())], ["vec_id", "v", "last"])

    queries = index.where(is_query(F.col("vec_id"))).select("vec_id", "v").mapInArrow(
        end_of_traversal, "vec_id long, v array<double>, last double")
    sent = store(queries).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "grp": []})
        return _search(left, right, first, second, k)

    lists = sent.groupBy("grp").cogroup(dealt.groupBy("grp")).applyInPandas(
        rerank, "query_id long, vec_id long, score double, grp int")
    return merge_lists(lists, groups, k)
