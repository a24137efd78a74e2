"""Near copies by SimHash, then by word shingles: links between texts whose sets of shingles have a Jaccard similarity of at least SIMILARITY.

First come the links of ``simhash`` (fingerprints of the same shingles within its radius), each verified by its exact
similarity. SimHash misses many copies at 0.8, so candidates for what it leaves apart come from MinHash bands: two texts of
similarity s meet in some band with chance 1 - (1 - s^ROWS)^BANDS, which is 0.99999 at 0.8 and more above. Each candidate
pair is verified once, so nothing below the similarity is linked.

Texts of one set of shingles are merged first. Within a band's bucket, one member of each group found so far meets the
bucket's first one: in the first bands, then in more (``STEPS``), then in all, round after round. What earlier bands linked is one group, so
a dense group of n near copies costs about n pairs, neither n^2 nor n a band. What
still shares a bucket with another group when no round links any more meets pair by pair, so no candidate is left untested.

Defined cases: as in ``simhash``; texts without words are equal to each other and like no other. Sets are named by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlift.functions import meet
from joinlift.llm import simhash
from joinlift.llm.common import BROADCAST_ROWS, flat_bytes, lookup_join, slices, store, texts
from joinlift.llm.components import components

SIMILARITY = 0.8
BANDS = 30
ROWS = 5
STEPS = (2, 6, 14)         # bands that take part, before all do
AT_ONCE = 1 << 12
PIECE_BYTES = 2 << 20      # of texts whose shingles a task holds at once

_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (A-Z folded); one shingle where it has fewer words."""
    return np.unique(simhash.shingle_hashes(text, words))


def set_name(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), 42)


def bands(shingles: np.ndarray) -> np.ndarray:
    """The key of each band; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), AT_ONCE):
        np.minimum(least, (low[i:i + AT_ONCE] * _FACTORS + _SHIFTS).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about PIECE_BYTES of text: shingles take several times the memory of their text."""
    for batch in batches:
        for first, last in slices(flat_bytes(batch.column(column))[1], PIECE_BYTES):
            yield batch.slice(first, last - first)


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, fp, sim, bands) of every row: fp names the set of shingles, sim is the SimHash fingerprint of all shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            hashes = [simhash.shingle_hashes(t, words) for t in texts(batch.column(1))]
            sim = np.array([simhash.majority(h) for h in hashes], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            fp = np.array([set_name(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), pa.array(sim), _lists([bands(s) for s in sets])],
                                             ["id", "fp", "sim", "bands"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "id long, fp long, sim long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, text: str, words: int) -> DataFrame:
    """Stored (fp, shingles) of the sets in ``wanted`` (stored: fp, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            sets = [shingle_set(t, words) for t in texts(batch.column(0))]
            fp = np.array([set_name(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp), _lists(sets)], ["fp", "shingles"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(run, "fp long, shingles array<long>")
    hit = lookup_join(rows, wanted.withColumn("hit", F.lit(True)), "fp", "n").where("hit")
    # copies are combined before the shuffle
    return store(hit.groupBy("fp").agg(F.first("shingles").alias("shingles")))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b; stored) of at least this similarity; a join splits the partition of a set that many pairs hold."""
    x, y = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    if pairs.count() <= BROADCAST_ROWS:          # only the sets that they name travel
        x = x.join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi")
        pairs = F.broadcast(pairs)
    both = y.join(pairs, "b").join(x, "a")
    x, y = F.size("x"), F.size("y")
    both = both.where(F.least(x, y) >= F.greatest(x, y) * similarity)
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= (x + y - common) * similarity).select("a", "b")


def _by_simhash(rows: DataFrame) -> DataFrame:
    """Stored (a, b), a < b: sets that SimHash links; ``rows``: stored sketches."""
    each = rows.select("fp", "sim").distinct()
    distinct = store(each.groupBy(F.col("sim").alias("fp")).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("first")))
    first = distinct.select(F.col("fp").alias("sim"), "n", "first")
    within = lookup_join(each, first, "sim", "n").select(F.col("first").alias("u"), F.col("fp").alias("v"))
    across = simhash.links(distinct).join(first.select(F.col("sim").alias("a"), F.col("first").alias("u")), "a").join(
        first.select(F.col("sim").alias("b"), F.col("first").alias("v")), "b").select("u", "v")
    return store(within.unionByName(across).where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())


def _merged(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Stored (fp, label) after the links ``new`` (stored: a, b): only the groups that they connect go through the stars again."""
    ends = new.select(F.col("a").alias("fp")).unionByName(new.select(F.col("b").alias("fp"))).distinct()
    named = store(ends.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")))
    a, b = named.select(F.col("fp").alias("a"), F.col("label").alias("u")), named.select(F.col("fp").alias("b"), F.col("label").alias("v"))
    roots = components(new.join(a, "a").join(b, "b"), "u", "v").select(F.col("node").alias("label"), "component")
    # a group's first set has no row until now
    others = named.unionByName(roots.select(F.col("label").alias("fp"), "label")).distinct()
    every = labels.unionByName(others.join(labels.select("fp"), "fp", "left_anti"))
    return store(meet(every, roots, ["label"], ["fp"], "left").select("fp", F.coalesce("component", "label").alias("label")))


def links(docs: DataFrame, rows: DataFrame, text: str, words: int, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links that connect the same sets as all candidates of at least this similarity do. ``rows``: stored sketches."""
    raw = rows.select("fp", F.posexplode("bands").alias("nr", "band"))
    buckets = store(raw.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y"))
                    .where("x <> y").select("band", "n", F.lit(True).alias("hit")))
    entries = store(lookup_join(raw, buckets, "band", "n").where("hit").select("nr", "band", "fp").distinct())
    tested = _by_simhash(rows)
    named = entries.select("fp").unionByName(tested.select(F.col("a").alias("fp"))).unionByName(tested.select(F.col("b").alias("fp")))
    wanted = store(rows.join(named.distinct(), "fp", "left_semi").groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    sets = _sets(docs, wanted, text, words)
    found = store(_similar(tested, sets, similarity))

    def grouped() -> DataFrame:
        return store(entries.join(labels, "fp", "left").select("nr", "band", "fp", F.coalesce("label", "fp").alias("label")))

    def untested(pairs: DataFrame) -> DataFrame:
        return store(pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))

    labels = components(found, "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("label"))
    members, turn = grouped(), 0
    while True:
        upto = STEPS[turn] if turn < len(STEPS) else BANDS
        one = store(members.where(F.col("nr") < upto).groupBy("band", "label").agg(F.min_by("fp", F.xxhash64("fp", F.lit(turn))).alias("b")))
        open_ = store(one.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("a")).where("n > 1"))
        turn += 1
        if open_.isEmpty():
            if upto == BANDS:
                return found
            continue
        pairs = untested(lookup_join(one, open_, "band", "n").where("a is not null and a <> b"))
        new = store(_similar(pairs, sets, similarity))
        tested = tested.unionByName(pairs)
        if not new.isEmpty():
            found = store(found.unionByName(new))
            labels = _merged(labels, new)
            members = grouped()
        elif upto == BANDS:
            break
    rest = store(lookup_join(members, open_.drop("a").withColumn("hit", F.lit(True)), "band", "n").where("hit").drop("hit"))
    pairs = untested(rest.select("band", F.col("fp").alias("u"), F.col("label").alias("l")).join(
        rest.select("band", F.col("fp").alias("v"), F.col("label").alias("m")), "band").where("l < m").select(
        F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))
    return store(found.unionByName(_similar(pairs, sets, similarity)))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5,
               similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies, chosen as by ``simhash.keep_first``."""
    rows = store(sketches(docs, key, text, words))
    return simhash.keep_rows(docs, key, text, rows.select("id", "fp"), links(docs, rows, text, words, similarity),
                             lambda t: set_name(shingle_set(t, words)))
