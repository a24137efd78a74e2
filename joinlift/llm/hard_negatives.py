"""Hard-negative mining: exact integer scores by residue-number-system matrix products, then windowed selection.

Components are whole numbers. Each is taken modulo several small primes, balanced about zero, and the matrix of a tile is
multiplied once per prime in float32: with residues of at most 125 a product over ``DEPTH`` dimensions stays below 2^24, so every
sum is exact (wider vectors are multiplied in runs of ``DEPTH``). Chinese remaindering in balanced mixed radix then gives the signed score; the
number of primes follows from the largest squared length in the table, which bounds every score.

Two passes over tiles. The first meets each anchor with the rows of its own label and keeps its best positives; the second
meets it with all rows and keeps, for each positive, the best rows of other labels whose score lies in the positive's window.
A tile is (anchors of one tile) x (rows of one shard), both of bounded size, so neither a hot label nor a hot vector gathers in a
task. Lists of one anchor and positive are merged ``FAN`` shards at a time.

Defined cases: a row with a null id, label or vector, an empty vector, a null or non-finite component takes no part; neither does one whose
squared length is 2^62 or more, as its scores need not fit a long. Vectors of different lengths are no pair. Rows repeated under one
id count once, by the smallest label and vector. Ties go to the smaller id. An anchor without another row of its label has no positive and no rows;
nor has a positive with a negative score, whose window is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinlift.llm.common import store
from joinlift.llm.topk import select, usable

#: The largest primes below 2^8, whose balanced residues are at most 125.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199, 197)
DEPTH = 1024                # 1024 * 125^2 < 2^24
LARGEST = 2.0 ** 62         # squared length of a vector that takes part
SHARD_ROWS = 8_192
SHARD_NUMBERS = 2 ** 22     # of a shard's vectors: shards of wide vectors have fewer rows
TILE_ANCHORS = 512
CHUNK = 128                 # anchors whose scores are held at once
FAN = 16
#: A negative's score lies between 30/100 and 90/100 of the positive's.
WINDOW = (30, 90)


def moduli(largest: int) -> list[int]:
    """Primes enough to tell apart all whole numbers of at most ``largest`` in magnitude."""
    chosen, product = [], 1
    for p in PRIMES:
        chosen.append(p)
        product *= p
        if product > 2 * largest + 1:
            return chosen
    raise ValueError(f"scores of {largest} need more primes than there are")


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers modulo p as float32 in -(p-1)/2 .. (p-1)/2."""
    r = np.mod(x, p)
    r[r > p // 2] -= p
    return r.astype(np.float32)


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """int32 numbers modulo p, balanced about zero."""
    r = np.mod(x, np.int32(p))
    r -= np.where(r > p // 2, np.int32(p), np.int32(0))
    return r


def remainder_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p as balanced int32; every float32 sum is a whole number below 2^24, hence exact."""
    total = None
    for d in range(0, a.shape[1], DEPTH):
        part = balanced((a[:, d:d + DEPTH] @ b[:, d:d + DEPTH].T).astype(np.int32), p)
        total = part if total is None else balanced(total + part, p)
    return total


def reconstruct(remainders: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed number of each cell from its remainders: balanced mixed-radix digits, summed modulo 2^64."""
    digits: list[np.ndarray] = []
    score = np.zeros(remainders[0].shape, np.int64)
    weight = 1
    for i, (r, p) in enumerate(zip(remainders, primes)):
        left = r
        for d, q in zip(digits, primes[:i]):                 # (left - d) / q modulo p
            left = balanced((left - d) * np.int32(pow(q, -1, p)), p)
        digits.append(left)
        signed = weight % 2 ** 64
        score += left.astype(np.int64) * np.int64(signed - 2 ** 64 if signed >= 2 ** 63 else signed)
        weight *= p
    return score


class Residues:
    """A matrix of whole numbers as its residues modulo each prime."""

    def __init__(self, x: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [residues(x, p) for p in primes]

    def scores(self, other: Residues) -> np.ndarray:
        return reconstruct([remainder_product(a, b, p) for a, b, p in zip(self.parts, other.parts, self.primes)], self.primes)


def whole_numbers(table: DataFrame, vector: str, scale: int, key: str, label: Column) -> DataFrame:
    """(vec_id, label, v): one row per id, components floor(scale * x)."""
    rows = table.where(F.col(key).isNotNull() & label.isNotNull() & usable(F.col(vector)))
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * scale))
    square = F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, c: a + F.pow(F.floor(c * scale), F.lit(2.0)))
    rows = rows.where(square < LARGEST).select(F.col(key).cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), x.alias("v")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def _tiles(anchors: DataFrame, rows: DataFrame, keys: list[str], primes: list[int],
           keep: Callable[[pa.Table, pa.Table, np.ndarray], Iterator[tuple]], schema: str) -> DataFrame:
    """Calls ``keep(anchors, rows, scores)`` for every tile; ``keys`` name the tile and are on both sides. All vectors of a tile have one width."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            width = left["width"][0].as_py()
            b = Residues(_matrix(right["v"], width), primes)
            for start in range(0, len(left), CHUNK):
                some = left.slice(start, CHUNK)
                found.extend(keep(some, right, Residues(_matrix(some["v"], width), primes).scores(b)))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=names)])

    fields = [f.split() for f in schema.split(", ")]
    names = [n for n, _ in fields]
    kinds = [pa.int32() if t == "int" else pa.int64() for _, t in fields]
    anchors = anchors.toDF(*anchors.columns)            # columns of its own: both sides come from one table
    return anchors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, schema)


def _merge(lists: DataFrame, by: list[str], score: str, key: str, k: int, groups: int) -> DataFrame:
    """The best k per ``by`` with their rank, from lists of ``grp`` groups, ``FAN`` groups at a time."""
    while True:
        groups = -(-groups // FAN)
        lists = lists.withColumn("grp", F.floor(F.col("grp") / FAN).cast("int"))
        rank = F.row_number().over(Window.partitionBy(*by, *([] if groups <= 1 else ["grp"])).orderBy(F.desc(score), key))
        lists = lists.withColumn("rank", rank).where(F.col("rank") <= k)
        if groups <= 1:
            return lists
        lists = lists.drop("rank")


def _place(column: Column, parts: Column | int) -> Column:
    """A hash part of 0 .. parts - 1."""
    return F.pmod(F.xxhash64(column), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def mine(table: DataFrame, anchor: Callable[[Column], Column], *, positives: int = 5, negatives: int = 10, window: tuple[int, int] = WINDOW,
         scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: Column | None = None,
         shard_rows: int = SHARD_ROWS, tile_anchors: int = TILE_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), as the module says.

    ``anchor`` tells from the id which rows are anchors, ``label`` is the column to go by (``label`` if not given), and a negative's score s
    must satisfy window[0] * p <= 100 * s <= window[1] * p for the positive's score p.
    """
    found = whole_numbers(table, vector, scale, key, F.col("label") if label is None else label)
    rows = store(found.withColumn("width", F.size("v")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = rows.agg(F.max(square)).first()[0] or 0.0
    primes = moduli(int(largest * (1 + 1e-9)) + 1)

    # how many shards and tiles each label and each width has: one row per label, and per width
    is_anchor = anchor(F.col("vec_id"))
    counts = rows.groupBy("width", "label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("a"))
    counts = store(counts.where("a > 0"))

    def parts(n: str, most: int) -> Column:
        return F.ceil(F.col(n) / F.greatest(F.lit(1), F.least(F.lit(most), F.floor(SHARD_NUMBERS / F.col("width"))))).cast("int")
    per_label = counts.select("width", "label", parts("n", shard_rows).alias("shards"), parts("a", tile_anchors).alias("tiles"))
    widths = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("a")).where("a > 0")
    per_width = store(widths.select("width", parts("n", shard_rows).alias("shards"), parts("a", tile_anchors).alias("tiles")))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # first pass: rows of the anchor's label
    of_label = rows.join(per_label, ["width", "label"])
    left = of_label.where(is_anchor).select("width", "label", _place(F.col("vec_id"), F.col("tiles")).alias("tile"), every("shards").alias("grp"), "vec_id", "v")
    right = of_label.select("width", "label", every("tiles").alias("tile"), _place(F.col("vec_id"), F.col("shards")).alias("grp"), "vec_id", "v")

    def best_positives(some: pa.Table, others: pa.Table, scores: np.ndarray) -> Iterator[tuple]:
        ids = others["vec_id"].to_numpy()
        grp = others["grp"][0].as_py()
        for own, row in zip(some["vec_id"].to_pylist(), scores):
            at = np.flatnonzero(ids != own)
            for j in at[select(row[at], ids[at], positives)]:
                yield own, int(ids[j]), int(row[j]), grp

    groups = per_width.agg(F.max("shards")).first()[0] or 1
    lists = _tiles(left, right, ["width", "label", "tile", "grp"], primes, best_positives, "anchor_id long, positive_id long, positive_score long, grp int")
    chosen = _merge(lists, ["anchor_id"], "positive_score", "positive_id", positives, groups).select("anchor_id", "positive_id", "positive_score")
    # at most ``positives`` entries per anchor
    wanted = store(chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("wanted")))

    # second pass: all rows of other labels
    of_width = rows.join(per_width, "width")
    left = (of_width.where(is_anchor).withColumnRenamed("vec_id", "anchor_id").join(wanted, "anchor_id")
            .select("width", _place(F.col("anchor_id"), F.col("tiles")).alias("tile"), every("shards").alias("grp"), "anchor_id", "label", "v",
                    F.col("wanted.positive_id").alias("p_ids"), F.col("wanted.positive_score").alias("p_scores")))
    right = of_width.select("width", every("tiles").alias("tile"), _place(F.col("vec_id"), F.col("shards")).alias("grp"), "vec_id", "label", "v")
    least, top = window

    def in_windows(some: pa.Table, others: pa.Table, scores: np.ndarray) -> Iterator[tuple]:
        ids, labels = others["vec_id"].to_numpy(), others["label"].to_numpy()
        grp = others["grp"][0].as_py()
        for own, its, p_ids, p_scores, row in zip(*(some[c].to_pylist() for c in ("anchor_id", "label", "p_ids", "p_scores")), scores):
            bounds = [(-(-least * p // 100), top * p // 100) for p in p_scores]      # whole numbers, so nothing is rounded
            at = np.flatnonzero((labels != its) & (row >= min(b for b, _ in bounds)) & (row <= max(b for _, b in bounds)))
            near, its_ids = row[at], ids[at]
            for p_id, p, (low, high) in zip(p_ids, p_scores, bounds):
                fit = np.flatnonzero((near >= low) & (near <= high))
                for j in fit[select(near[fit], its_ids[fit], negatives)]:
                    yield own, p_id, p, int(its_ids[j]), int(near[j]), grp

    lists = _tiles(left, right, ["width", "tile", "grp"], primes, in_windows,
                   "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, grp int")
    best = _merge(lists, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives, groups)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
