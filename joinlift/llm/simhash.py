"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within distance r agree in some segment up to that segment's share of
r (the radii below are the smallest for which this must hold), so it is enough to enumerate a small Hamming ball
around each segment value, fetch the table entries under those values and verify whole distances.

Equal fingerprints are merged first. Table entries of one segment value are kept as lists, probed as a whole, and
links are reduced to a spanning set per pair of lists, so a dense group of n near copies gives about n links, not n^2. A
list of more than ``CHUNK`` entries is cut into chunks that meet pairwise in different tasks.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and links like any other. A null id takes
part, but is never a component's smallest id; a component of null ids alone has a null id. Repeated rows link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinlift.llm.common import lookup_join, position, store, texts, with_columns
from joinlift.llm.components import components

BITS = 64
RADIUS = 4
SEGMENTS = 3
CHUNK = 2_048
HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """64-bit hashes of the word shingles of a text (A-Z folded, repeats included); one shingle where it has fewer words."""
    parts = text.lower().split()
    k = min(words, len(parts))
    if not k:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[:len(parts) - k + 1].tolist(), ends[k - 1:].tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(first, last)), np.uint64, len(first))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have; none: zero."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        h = hashes[i:i + HASHES_AT_ONCE].astype("<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int) -> int:
    """64-bit SimHash of the word shingles of a text (A-Z folded, repeats counted); no words: zero."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "id long, fp long")


def radii(segments: int, radius: int) -> list[int]:
    """The least radii of which one must hold: their sum is radius + 1 - segments; -1 needs no probe."""
    share, rest = divmod(radius + 1 - segments, segments)
    return [share + (i < rest) for i in range(segments)]


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def spanning(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within ``radius`` between ``a`` and ``b`` connect; fewer than len(a) + len(b)."""
    nodes = np.concatenate([a, b])
    side = np.arange(len(nodes)) < len(a)
    left, right = [], []
    todo = np.ones(len(nodes), bool)
    for start in range(len(a)):
        if not todo[start]:
            continue
        todo[start] = False
        frontier = [start]
        while frontier:
            at = frontier.pop()
            open_ = np.flatnonzero(todo & (side != side[at]))
            found = open_[np.bitwise_count(nodes[open_] ^ nodes[at]) <= radius]
            if len(found):
                todo[found] = False
                frontier.extend(found.tolist())
                left.append(np.full(len(found), nodes[at]))
                right.append(nodes[found])
    if not left:
        return nodes[:0], nodes[:0]
    return np.concatenate(left), np.concatenate(right)


def _verify(pairs: DataFrame, radius: int) -> DataFrame:
    """Links of pairs of lists."""
    def lists(column: pa.Array) -> list[np.ndarray]:
        ends = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
        return [values[i:j] for i, j in zip(ends[:-1], ends[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spanning(a, b, radius) for a, b in zip(lists(batch.column(0)), lists(batch.column(1)))]
            for k in range(0, len(found), 1024):
                out = [np.concatenate([x[i] for x in found[k:k + 1024]]).view(np.int64) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within ``radius`` do. ``distinct``: stored, one fp a row."""
    reach = radii(segments, radius)
    bounds = segment_bounds(segments)
    values = [F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)).alias("val"))
              for s, (at, width) in enumerate(bounds) if reach[s] >= 0]
    entries = distinct.select("fp", F.explode(F.array(*values)).alias("e")).select("fp", "e.seg", "e.val")
    # lists that would be long are cut by hash; there are few, since each takes more than ``chunk`` entries
    long = store(entries.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
                 .select(F.struct("seg", "val").alias("at"), "n", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    entries = lookup_join(entries.withColumn("at", F.struct("seg", "val")), long, "at", "n")
    lists = store(entries.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
                  .groupBy("seg", "val", "chunk").agg(F.collect_list("fp").alias("fps"), F.first("chunks").alias("chunks")))

    # each unordered pair of values is probed once, from the smaller one; the value itself only where it has chunks
    flips = []
    for s, (_, width) in enumerate(bounds):
        masks = [sum(1 << b for b in bits) for d in range(1, reach[s] + 1) for bits in combinations(range(width), d)]
        flips.append(F.array(*[F.lit(m).cast("long") for m in masks]) if masks else F.array().cast("array<long>"))
    ball = F.element_at(F.array(*flips), F.col("seg") + 1) if len(flips) > 1 else flips[0]
    near = F.filter(F.transform(ball, lambda m: F.col("val").bitwiseXOR(m)), lambda v: v > F.col("val"))
    own = F.when(F.col("chunks") > 1, F.array("val")).otherwise(F.array().cast("array<long>"))
    probes = lists.select("seg", F.explode(F.concat(near, own)).alias("val"), F.col("val").alias("from"),
                          F.col("chunk").alias("c"), F.col("fps").alias("a"))
    met = probes.join(lists.select("seg", "val", "chunk", F.col("fps").alias("b")), ["seg", "val"]).where(
        ((F.col("from") != F.col("val")) | (F.col("chunk") > F.col("c")))
        & ((F.size("a") > 1) | (F.size("b") > 1) | (F.bit_count(F.col("a")[0].bitwiseXOR(F.col("b")[0])) <= radius)))
    one = (F.size("a") == 1) & (F.size("b") == 1)
    met = store(met.select("a", "b").unionByName(
        lists.where(F.size("fps") > 1).select(F.col("fps").alias("a"), F.col("fps").alias("b"))))
    direct = met.where(one).select(F.col("a")[0].alias("a"), F.col("b")[0].alias("b"))
    return direct.unionByName(_verify(met.where(~one), radius))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4,
                    radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) of every row."""
    rows = store(fingerprints(docs, key, text, words))
    distinct = _distinct(rows)
    return lookup_join(rows, _groups(distinct, links(distinct, radius)), "fp", "n").select("id", "fp", "component_id")


def _distinct(rows: DataFrame) -> DataFrame:
    return store(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))


def _groups(distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """Stored (fp, n, root, component_id): root names the component by a fingerprint."""
    roots = components(linked, "a", "b").select(F.col("node").alias("fp"), "component")
    rooted = store(distinct.join(roots, "fp", "left").select(
        "fp", "n", "first", F.coalesce("component", "fp").alias("root")))
    least = store(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("m")))
    return store(lookup_join(rooted, least, "root", "m").select("fp", "n", "root", "component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4,
               radius: int = RADIUS) -> DataFrame:
    """One row of each component, with its own columns: one of the component's smallest id (null: of its smallest fingerprint).

    Ids that name one fingerprint are matched by id alone, so texts are hashed once. Only rows
    without an id, or whose id names several fingerprints, are hashed again and matched by id and fingerprint.
    """
    rows = store(fingerprints(docs, key, text, words))
    return keep_rows(docs, key, text, rows, links(_distinct(rows), radius), lambda t: fingerprint(t, words))


def keep_rows(docs: DataFrame, key: str, text: str, rows: DataFrame, linked: DataFrame,
              fingerprint_of: Callable[[bytes], int]) -> DataFrame:
    """``keep_first`` for any fingerprint and links. ``rows``: stored (id, fp) of every row."""
    placed = lookup_join(rows, _groups(_distinct(rows), linked), "fp", "n")
    wanted = store(placed.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", "id")
                   .agg(F.min("fp").alias("__fp")).select(F.col("id").alias("__id"), "__fp"))
    several = store(rows.where("id is not null").groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y"))
                    .where("x <> y").select(F.col("id").alias("__id")))
    own = F.col(key).cast("long")
    order = [F.xxhash64(F.col(text)), F.col(text)]
    plain = docs.join(wanted.join(several, "__id", "left_anti").select("__id"), own == F.col("__id"), "left_semi")
    plain = _first_row(plain, [F.col(key)], order)
    again = _with_fingerprint(docs.where(F.col(key).isNull()).unionByName(
        docs.join(several, own == F.col("__id"), "left_semi")), text, fingerprint_of)
    again = again.join(wanted, own.eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__fp")), "left_semi")
    return plain.unionByName(_first_row(again, [F.col(key), F.col("__own")], order).drop("__own"))


def _first_row(frame: DataFrame, by: list, order: list) -> DataFrame:
    """The first row of each group; Spark limits groups before the shuffle, so copies don't meet in one task."""
    return frame.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(
        "__rank = 1").drop("__rank")


def _with_fingerprint(docs: DataFrame, text: str, fingerprint_of: Callable[[bytes], int]) -> DataFrame:
    """Every column, and the fingerprint as ``__own``."""
    at = position(docs, text)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), "__own long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint_of(t) for t in texts(batch.column(at))], np.uint64).view(np.int64)
            yield with_columns(batch, __own=pa.array(fp))

    return docs.mapInArrow(run, schema)
