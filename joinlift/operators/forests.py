"""Regression forests of many groups at once: histogram trees over binned features.

Features are cut at quantiles per group and rows packed into blocks of bytes. A tree grows level by level: for every node the
sums per (feature, bin) give the best split. Where a group's rows are few (``LOCAL_NUMBERS``), tasks take a share of its trees each
and grow them from the group's blocks. In a larger group every block adds its own sums and the levels are jobs: one aggregate
per depth for all groups and trees of a bunch. Both ways see the same bins, weights and choices of features, so
they grow the same trees, up to rounding of sums.

Rows weigh what a Poisson draw from a hash of (seed, tree, row) gives, and a node's features are chosen by a hash of (seed, tree,
node): a lost task repeats itself exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinlift.functions.blocks import add_segments, segments
from joinlift.functions.spread import materialise

BINS = 32
BLOCK_ROWS = 50_000
BLOCK_NUMBERS = 8_000_000       # bytes of bins in a block
LOCAL_NUMBERS = 256_000_000     # bytes of a group whose trees are grown within tasks: a row has ROW_BYTES and one a feature
ROW_BYTES = 16
SLICE_ROWS = 1 << 17            # rows whose sums a task works on at a time
TASK_TREES, LEAST_TREES = 10, 4  # of a task, unless that makes more tasks than three a core, or fewer than cores
HELD_NUMBERS = 16_000_000       # of a level's sums in a task: it says how many trees share a job
ACCURACY = 1_000                # of the quantiles that cut features: ranks are off by at most 1/ACCURACY of the rows

#: Chances of at most 0, 1, 2, ... draws with mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])

#: Draws by the upper 16 bits of a hash; -1 where these do not tell.
_DRAWS = np.searchsorted(POISSON, np.arange(1 << 16) / 2.0 ** 16, "right").astype(np.int8)
_DRAWS[np.floor(POISSON * 2 ** 16).astype(int).clip(max=(1 << 16) - 1)] = -1

TREE = "seed int, tree int, node array<int>, feature array<int>, cut array<double>, value array<double>, weight array<double>, gain array<double>"
_TREE_TYPES = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.list_(pa.float64())] * 4)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the splitmix finaliser)."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mixed_rows(x: np.ndarray) -> np.ndarray:
    """The same in the place of an array."""
    y = np.empty_like(x)
    x += np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(x, np.uint64(shift), out=y)
        x ^= y
        if factor is not None:
            x *= np.uint64(factor)
    return x


def _of(seed: int, tree: int) -> np.uint64:
    with np.errstate(over="ignore"):
        return _mix(_mix(np.uint64(seed & 0xFFFFFFFF)) ^ np.uint64(tree))


def draws(hashes: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in the tree's sample."""
    return _drawn(hashes, seed, tree).astype(np.float64)


def _drawn(hashes: np.ndarray, seed: int, tree: int) -> np.ndarray:
    u = _mixed_rows(np.asarray(hashes, np.uint64) ^ _of(seed, tree))
    out = _DRAWS.take((u >> np.uint64(48)).view(np.int64))
    open_ = np.flatnonzero(out < 0)                      # a step lies in the slice
    out[open_] = np.searchsorted(POISSON, (u[open_] >> np.uint64(11)).astype(np.float64) / 2.0 ** 53, "right")
    return out


def chosen(seed: int, tree: int, nodes: np.ndarray, n_features: int, n: int) -> np.ndarray:
    """The features each node may split on: ``n`` of them, in ascending order."""
    if n >= n_features:
        return np.tile(np.arange(n_features), (len(nodes), 1))
    with np.errstate(over="ignore"):
        h = _mix(_mix(nodes.astype(np.uint64) ^ _of(seed, tree))[:, None] ^ np.arange(n_features, dtype=np.uint64)[None, :])
    return np.sort(np.argsort(h, axis=1, kind="stable")[:, :n], axis=1)


def sums_by_bin(bins: np.ndarray, w: np.ndarray, wy: np.ndarray, at: np.ndarray, features: np.ndarray, rows: np.ndarray | None = None,
                onto: np.ndarray | None = None) -> np.ndarray:
    """(nodes, features of a node, 2, BINS): weight and weighted target per bin. ``at``: each row's node, as a place in ``features``.

    ``rows``: the numbers of the rows of ``bins`` that take part (all of them where there are none). ``onto``: the sums of earlier rows,
    to which these add one by one, so that slices give the very sums of the whole.
    """
    m, c = features.shape
    out = np.empty((m, c, 2, BINS)) if onto is None else onto
    flat, first = bins.reshape(-1), (np.arange(len(at)) if rows is None else rows) * np.int64(bins.shape[1])
    base = at * BINS
    for i in range(c):
        key = base + flat.take(first + features[:, i].take(at))
        weight = np.bincount(key, w, m * BINS).reshape(m, BINS)
        if onto is None:
            out[:, i, 0] = weight
            out[:, i, 1] = np.bincount(key, wy, m * BINS).reshape(m, BINS)
        else:
            out[:, i, 0] += weight                       # whole numbers
            target = out[:, i, 1].ravel()
            np.add.at(target, key, wy)                   # one by one, as bincount does
            out[:, i, 1] = target.reshape(m, BINS)
    return out


def best_splits(sums: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node: (feature or -1, last bin on the left, gain, weight, weighted target); ties go to the earlier feature, then the lower bin."""
    weight, target = sums[:, :, 0], sums[:, :, 1]
    whole, total = weight[:, 0].sum(axis=1), target[:, 0].sum(axis=1)
    wl, sl = weight.cumsum(axis=2)[:, :, :-1], target.cumsum(axis=2)[:, :, :-1]
    wr, sr = whole[:, None, None] - wl, total[:, None, None] - sl
    fine = (wl > 0.5) & (wr > 0.5)                       # weights are whole numbers
    gain = np.where(fine, sl ** 2 / np.where(fine, wl, 1) + sr ** 2 / np.where(fine, wr, 1), -np.inf)
    flat = gain.reshape(len(gain), -1)
    place = flat.argmax(axis=1)
    base = total ** 2 / np.where(whole > 0, whole, 1)
    best = flat[np.arange(len(flat)), place] - base
    split = best > 1e-12 * np.maximum(base, 1e-300)
    i, b = np.divmod(place, BINS - 1)
    return np.where(split, features[np.arange(len(features)), i], -1), b, np.where(split, best, 0.0), whole, total


class Tree:
    """A growing tree: numbered as a heap (children of i: 2 i + 1 and 2 i + 2); open nodes are those of the last level."""

    def __init__(self, seed: int, tree: int, n_features: int, share: float):
        self.seed, self.tree, self.n_features = seed, tree, n_features
        self.n = max(1, math.ceil(share * n_features))
        self.open = np.array([0])
        self._known = None
        self.nodes: list[tuple] = []                     # (node, feature, bin, gain, weight, weighted target)

    def features(self) -> np.ndarray:
        return chosen(self.seed, self.tree, self.open, self.n_features, self.n)

    def take(self, feature, last, gain, weight, total, deepest: bool) -> None:
        """Closes the open nodes by their best splits; the children of split ones are open next."""
        if deepest:
            feature, gain = np.full(len(feature), -1), np.zeros(len(gain))
        self.nodes += list(zip(self.open.tolist(), feature.tolist(), last.tolist(), gain.tolist(), weight.tolist(), total.tolist()))
        parents = self.open[feature >= 0]
        self.open = np.sort(np.concatenate([2 * parents + 1, 2 * parents + 2]))

    def _ways(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per node its feature, its last bin on the left and its place among the open ones; made once a level."""
        known = (len(self.nodes), len(self.open))
        if self._known is None or self._known[0] != known:
            size = max(int(self.open.max(initial=0)), max(n[0] for n in self.nodes)) + 1
            feature, last, place = np.full(size, -1), np.zeros(size, int), np.full(size, -1)
            node, f, b = (np.array(c) for c in list(zip(*self.nodes))[:3])
            feature[node], last[node] = f, b
            place[self.open] = np.arange(len(self.open))
            self._known = known, (feature, last, place)
        return self._known[1]

    def places(self, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The place of each of ``rows`` among the open nodes; -1 where it has come to a leaf."""
        if not self.nodes:
            return np.zeros(len(rows), int)
        feature, last, place = self._ways()
        out, moving = np.full(len(rows), -1), np.arange(len(rows))
        at, first, flat = np.zeros(len(rows), int), rows * np.int64(bins.shape[1]), bins.reshape(-1)
        while len(moving):
            f = feature[at]
            still = np.flatnonzero(f >= 0)
            if len(still) < len(at):                     # the others are at a leaf or an open node
                ends = np.flatnonzero(f < 0)
                out[moving[ends]] = place[at[ends]]
                moving, at, first, f = moving[still], at[still], first[still], f[still]
            at = 2 * at + 1 + (flat.take(first + f) > last[at])
        return out

    def row(self, cuts: Sequence[Sequence[float]], mean: float) -> tuple:
        node, feature, last, gain, weight, total = (list(c) for c in zip(*self.nodes))
        value = [mean + (t / w if w else 0.0) for w, t in zip(weight, total)]
        cut = [cuts[f][b] if f >= 0 else 0.0 for f, b in zip(feature, last)]
        return self.seed, self.tree, node, feature, cut, value, weight, gain


class _Rows:
    """The sampled rows of a slice of a group that have not come to a leaf: their numbers, weights and places among the open nodes."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, hashes: np.ndarray, seed: int, number: int):
        w = _drawn(hashes, seed, number)
        self.bins, self.y, self.rows = bins, y, np.flatnonzero(w).astype(np.int32)
        self.w, self.at = w[self.rows].astype(np.uint8), np.zeros(len(self.rows), np.int32)

    def sums(self, features: np.ndarray, onto: np.ndarray | None) -> np.ndarray:
        w = self.w.astype(np.float64)
        return sums_by_bin(self.bins, w, w * self.y[self.rows], self.at.astype(np.intp), features, self.rows, onto)

    def move(self, feature: np.ndarray, last: np.ndarray, child: np.ndarray) -> None:
        """Rows go to the children of split nodes; ``child``: the place of each node's left child among the nodes open next."""
        own = feature[self.at]
        stay = np.flatnonzero(own >= 0)
        self.rows, self.w, own, at = self.rows[stay], self.w[stay], own[stay], self.at[stay]
        right = self.bins.reshape(-1).take(self.rows * np.int64(self.bins.shape[1]) + own) > last[at]
        self.at = (child[at] + right).astype(np.int32)


def grow(bins: np.ndarray, y: np.ndarray, hashes: np.ndarray, seed: int, number: int, depth: int, share: float) -> Tree:
    """One tree from all rows of a group."""
    return grow_from([(bins, y, hashes)], seed, number, depth, share)


def grow_from(blocks: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int, number: int, depth: int, share: float) -> Tree:
    """One tree from the blocks (bins, y, hash) of a group, which are read in slices and never copied as a whole."""
    tree = Tree(seed, number, blocks[0][0].shape[1], share)
    parts = [_Rows(b[i:i + SLICE_ROWS], y[i:i + SLICE_ROWS], h[i:i + SLICE_ROWS], seed, number)
             for b, y, h in blocks for i in range(0, len(y), SLICE_ROWS)]
    for level in range(depth + 1):
        if not len(tree.open):
            break
        deepest = level == depth
        features = np.zeros((len(tree.open), 1), int) if deepest else tree.features()      # no split any more: one feature has the sums
        sums = None
        for part in parts:
            sums = part.sums(features, sums)
        split = best_splits(sums, features)
        before = tree.open
        tree.take(*split, deepest=deepest)
        if len(tree.open):
            child = np.searchsorted(tree.open, 2 * before + 1)
            for part in parts:
                part.move(split[0], split[1], child)
    return tree


# Spark: cuts, blocks, trees

def _types(rows: DataFrame, group: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return "".join(f"`{g}` {types[g]}, " for g in group)


def _slices(n: str, width: str):
    return F.ceil(F.col(n) / F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(BLOCK_NUMBERS / F.greatest(F.lit(1), F.col(width)))))).cast("int")


def blocks_of(rows: DataFrame, group: Sequence[str], key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Stored (group, n, width, mean, cuts) and (group, slice, n, bins, y, hash): rows in blocks, features as bins.

    ``rows``: (group, key, xs, y) with ``xs`` of one length per group. Rows without a target take no part; a missing feature is 0.
    """
    whole = [F.col(g) for g in group]
    xs = F.when(F.size("xs") == 0, F.array(F.lit(0.0))).otherwise(F.col("xs"))
    rows = materialise(rows.where("y is not null").select(
        *whole, F.transform(xs, lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))).alias("xs"), F.col("y").cast("double").alias("y"),
        F.xxhash64(*key).alias("hash")))
    at = [i / BINS for i in range(1, BINS)]
    quantiles = rows.select(*group, F.posexplode("xs").alias("i", "x")).groupBy(*group, "i").agg(
        F.array_distinct(F.percentile_approx("x", at, ACCURACY)).alias("cuts"))
    cuts = quantiles.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "cuts"))), lambda e: e["cuts"]).alias("cuts"))
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("xs")).alias("width"), F.avg("y").alias("mean"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"__c_{g}").eqNullSafe(F.col(g))
    groups = materialise(sizes.join(cuts.select(*[F.col(g).alias(f"__c_{g}") for g in group], "cuts"), same, "left").select(
        *group, "n", "width", "mean", F.coalesce("cuts", F.array()).alias("cuts")).withColumn("slices", _slices("n", "width")))
    few = groups.select(*[F.col(g).alias(f"__c_{g}") for g in group], "slices")        # one row per group
    dealt = rows.join(few, same).withColumn("slice", F.pmod("hash", F.col("slices")).cast("int")).drop("slices", *[f"__c_{g}" for g in group])
    sent = groups.select(*group, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "width", "mean", "cuts")
    sent = sent.toDF(*sent.columns)

    def pack(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _empty
        width = right["width"][0].as_py()
        x = left["xs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(left), width)
        bins = np.empty((len(left), width), np.uint8)
        for i, c in enumerate(right["cuts"][0].as_py()):
            bins[:, i] = np.searchsorted(c, x[:, i], "left")                           # how many cuts lie below
        y = left["y"].to_numpy() - right["mean"][0].as_py()
        return pa.table({**{g: right[g] for g in group}, "slice": right["slice"], "n": pa.array([len(left)], pa.int32()),
                         "bins": pa.array([bins.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary()),
                         "hash": pa.array([left["hash"].to_numpy().tobytes()], pa.binary())})

    schema = f"{_types(rows, group)}slice int, n int, bins binary, y binary, hash binary"
    arrow = {f.name: f.type for f in _arrow_fields(rows, group)}
    _empty = pa.table({**{g: pa.array([], arrow[g]) for g in group}, "slice": pa.array([], pa.int32()), "n": pa.array([], pa.int32()),
                       **{c: pa.array([], pa.binary()) for c in ("bins", "y", "hash")}})
    packed = dealt.groupBy(*group, "slice").cogroup(sent.groupBy(*group, "slice")).applyInArrow(pack, schema)
    return groups, materialise(packed)


def _arrow_fields(rows: DataFrame, group: Sequence[str]) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type
    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in rows.schema if f.name in group]


def _unpacked(blocks: Iterator[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [_opened(b["bins"], b["y"], b["hash"], width) for b in sorted(blocks, key=lambda b: b["slice"])]
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def _opened(bins, y, hashes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(bins, np.uint8).reshape(-1, width), np.frombuffer(y, "<f8"), np.frombuffer(hashes, "<u8")


def _blocks(table: pa.Table, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A group's blocks in the order of their slices, as views of the table."""
    order = np.argsort(table["slice"].to_numpy(), kind="stable").tolist()
    return [_opened(*(table[c][i].as_buffer() for c in ("bins", "y", "hash")), width) for i in order]


def fit_forests(rows: DataFrame, group: Sequence[str], key: Sequence[str], *, trees: int = 100, depth: int = 10, seeds: Sequence[int] | None = (42,),
                share: float = 1 / 3, local_numbers: int = LOCAL_NUMBERS) -> DataFrame:
    """Trees of every group and seed, one row each (``TREE``); ``rows``: (group, key, xs, y). Stored.

    Without ``seeds`` the last column of ``group`` is each group's seed. ``share`` of the features may split a node. A tree's arrays list its nodes: heap number, feature (-1: leaf), cut (at most it: left),
    mean of the target, weight and gain (decrease of the sum of squares).
    """
    groups, blocks = blocks_of(rows, group, key)
    wanted = [(s, t) for s in ((None,) if seeds is None else seeds) for t in range(trees)]
    size = F.col("n").cast("double") * (F.greatest(F.col("width"), F.lit(1)) + ROW_BYTES)
    small = groups.where(size <= local_numbers)
    large = groups.where(size > local_numbers).orderBy(*group).collect()               # one row per large group
    grown = _grow_in_tasks(small, blocks, group, wanted, depth, share)
    if not large:
        return materialise(grown)
    out = materialise(grown)
    for r in large:
        out = out.unionByName(_grow_by_levels(r, blocks, group, wanted, depth, share))
    return out


def _grow_in_tasks(groups: DataFrame, blocks: DataFrame, group: Sequence[str], wanted: Sequence[tuple[int | None, int]], depth: int, share: float) -> DataFrame:
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    shares = min(max(-(-len(wanted) // TASK_TREES), min(cores, -(-len(wanted) // LEAST_TREES))), 3 * cores)
    shares = max(min(shares, cores), shares // cores * cores)                          # full rounds of the cores
    tasks = max(1, min(4 * shares * groups.count(), 12 * cores))                       # more than shares, so that few meet in one
    turns = _turns(groups, group, shares, tasks)
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"__c_{g}").eqNullSafe(F.col(g))
    few = turns.select(*[F.col(g).alias(f"__c_{g}") for g in group], "__share", "__turn")
    own = [f"__c_{g}" for g in group]
    sent = groups.select(*group, "width", "mean", "cuts").join(few, same).drop(*own)
    sent = sent.toDF(*sent.columns)
    dealt = blocks.join(few.drop("__share"), same).drop(*own)
    fields = _arrow_fields(blocks, group)
    names = [*group, *(f.split()[0] for f in TREE.split(", "))]
    types = [*[next(f.type for f in fields if f.name == g) for g in group], *_TREE_TYPES]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            of = right.to_pylist()[0]
            own = _blocks(left, of["width"])
            for seed, number in wanted[of["__share"]::shares]:
                tree = grow_from(own, of[group[-1]] if seed is None else seed, number, depth, share)
                found.append((*(of[g] for g in group), *tree.row(of["cuts"], of["mean"])))
        return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=names)
    dealt, sent = (side.repartition(tasks, *group, "__turn") for side in (dealt, sent))
    return dealt.groupBy(*group, "__turn").cogroup(sent.groupBy(*group, "__turn")).applyInArrow(run, f"{_types(blocks, group)}{TREE}")


def _turns(groups: DataFrame, group: Sequence[str], shares: int, tasks: int) -> DataFrame:
    """Stored (group, __share, __turn): a number for every share of a group's trees.

    Where there are no more shares than tasks, numbers are such that (group, number) hashes to a task of its own.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    if groups.count() * shares > tasks:
        return materialise(groups.select(*group, every.alias("__share")).withColumn("__turn", F.col("__share")))
    order = Window.orderBy(*group)                                                     # one row per group, and they are few
    numbered = materialise(groups.select(*group, F.row_number().over(order).alias("__i")))
    tried = numbered.select(*group, "__i", F.explode(F.sequence(F.lit(0), F.lit(32 * tasks))).alias("__n"))
    found = tried.groupBy("__i", F.pmod(F.hash(*group, "__n"), F.lit(tasks)).alias("__task")).agg(F.min("__n").alias("__n"))
    asked = numbered.select(*group, "__i", every.alias("__share")).withColumn("__task", (F.col("__i") - 1) * shares + F.col("__share"))
    return materialise(asked.join(found, ["__i", "__task"], "left").select(*group, "__share", F.coalesce("__n", -1 - F.col("__share")).alias("__turn")))


def _grow_by_levels(of, blocks: DataFrame, group: Sequence[str], wanted: Sequence[tuple[int | None, int]], depth: int, share: float) -> DataFrame:
    """The trees of one large group: a level is one aggregate over its blocks for all trees whose sums fit a task."""
    spark, width = blocks.sparkSession, of["width"]
    own = blocks
    for g in group:
        own = own.where(F.col(g).eqNullSafe(F.lit(of[g])))
    own = own.select("n", "bins", "y", "hash")
    names = f"{_types(blocks, group)}{TREE}"
    out = None
    left = [Tree(of[group[-1]] if s is None else s, t, width, share) for s, t in wanted]
    most = max(1, HELD_NUMBERS // (2 ** (depth - 1) * left[0].n * 2 * BINS))
    for first in range(0, len(left), most):
        some = left[first:first + most]
        for level in range(depth + 1):
            if not any(len(t.open) for t in some):
                break
            for i, split in _level(own, some, width, level == depth):
                some[i].take(*split, deepest=level == depth)
        rows = spark.createDataFrame([(*(of[g] for g in group), *t.row(of["cuts"], of["mean"])) for t in some], names)
        out = materialise(rows) if out is None else out.unionByName(materialise(rows))
    return out


def _level(blocks: DataFrame, trees: list[Tree], width: int, deepest: bool) -> list[tuple[int, tuple[np.ndarray, ...]]]:
    def features(t: Tree) -> np.ndarray:
        return np.zeros((len(t.open), 1), int) if deepest else t.features()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        wanted = {i: features(t) for i, t in enumerate(trees) if len(t.open)}

        def take(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
            bins, y, hashes = (np.concatenate(p) for p in zip(*parts))
            for i, f in wanted.items():
                t, w = trees[i], _drawn(hashes, trees[i].seed, trees[i].tree)
                rows = np.flatnonzero(w)
                at = t.places(bins, rows)
                still = np.flatnonzero(at >= 0)
                rows, at = rows[still], at[still]
                weight = w[rows].astype(np.float64)
                own = sums_by_bin(bins, weight, weight * y[rows], at, f, rows).reshape(len(f), -1)
                if i in held:
                    held[i] += own
                else:
                    held[i] = own
        parts, n = [], 0
        for batch in batches:
            for row in range(len(batch)):
                parts.append(_opened(*(batch.column(i)[row].as_buffer() for i in range(1, 4)), width))
                n += len(parts[-1][1])
                if n >= SLICE_ROWS:
                    take(parts)
                    parts, n = [], 0
        if parts:
            take(parts)
        for i, m in held.items():
            rows = list(segments(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i, np.int32)), pa.array([p for p, _ in rows], pa.int32()),
                                              pa.array([b for _, b in rows], pa.binary())], ["i", "place", "sums"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, place, sums in zip(*(c.to_pylist() for c in batch.columns)):
                f = features(trees[i])
                sums = np.frombuffer(sums, "<f8").reshape(-1, f.shape[1], 2, BINS)
                step = max(1, 1024 // (f.shape[1] * 2 * BINS))
                split = best_splits(sums, f[place * step:place * step + len(sums)])
                k = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, i, np.int32)), pa.array(np.arange(k, dtype=np.int32) + place * step),
                     *[pa.array(s.astype(t)) for s, t in zip(split, (np.int32, np.int32, np.float64, np.float64, np.float64))]],
                    ["i", "at", "feature", "last", "gain", "weight", "total"])
    merged = add_segments(blocks.mapInArrow(add, "i int, place int, sums binary"), ["i", "place"], "sums")
    got = merged.mapInArrow(choose, "i int, at int, feature int, last int, gain double, weight double, total double").toPandas()   # one row per node
    return [(int(i), tuple(p.sort_values("at")[c].to_numpy() for c in ("feature", "last", "gain", "weight", "total"))) for i, p in got.groupby("i")]


# what trees are for

def predict_forests(rows: DataFrame, forests: DataFrame, group: Sequence[str], key: Sequence[str], slice_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (group, key, xs, ...) with ``yhat``, the mean of the group's trees; rows of a group without trees have none and go."""
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"__c_{g}").eqNullSafe(F.col(g))
    sizes = materialise(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).select(
        *[F.col(g).alias(f"__c_{g}") for g in group], F.ceil(F.col("n") / slice_rows).cast("int").alias("__slices")))
    dealt = rows.join(sizes, same).withColumn("__slice", F.pmod(F.xxhash64(*key), F.col("__slices")).cast("int")).drop("__slices", *[f"__c_{g}" for g in group])
    sent = forests.join(sizes, same).select(*group, F.explode(F.sequence(F.lit(0), F.col("__slices") - 1)).alias("__slice"), "node", "feature", "cut", "value")
    sent = sent.toDF(*sent.columns)
    columns = [f.name for f in rows.schema]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(columns)
        if not len(left) or not len(right):
            return left.slice(0, 0).append_column("yhat", pa.array([], pa.float64()))
        x = left["xs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = np.nan_to_num(x.reshape(len(left), -1), nan=0.0) if len(x) else np.zeros((len(left), 1))
        total = np.zeros(len(x))
        for node, feature, cut, value in zip(*(right[c].to_pylist() for c in ("node", "feature", "cut", "value"))):
            size = max(node) + 1
            f, c, v = np.full(size, -1), np.zeros(size), np.zeros(size)
            f[node], c[node], v[node] = feature, cut, value
            at, all_ = np.zeros(len(x), int), np.arange(len(x))
            while True:
                now = f[at]
                moving = now >= 0
                if not moving.any():
                    break
                at = np.where(moving, 2 * at + 1 + (x[all_, np.maximum(now, 0)] > c[at]), at)
            total += v[at]
        return left.append_column("yhat", pa.array(total / len(right)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", yhat double"
    return dealt.groupBy(*group, "__slice").cogroup(sent.groupBy(*group, "__slice")).applyInArrow(run, schema)


def forest_importances(forests: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, seed, feature, importance): each tree's gains sum to one, and so do a forest's importances. Features that split nothing are left out."""
    by = [*group, "seed"]
    gains = forests.select(*by, "tree", F.inline(F.arrays_zip("feature", "gain"))).where("feature >= 0")
    per_tree = gains.groupBy(*by, "tree", "feature").agg(F.sum("gain").alias("__g"))
    entries = per_tree.groupBy(*by, "tree").agg(F.sum("__g").alias("__all"), F.collect_list(F.struct("feature", "__g")).alias("__e"))   # one entry per feature
    shares = entries.select(*by, "__all", F.inline("__e")).groupBy(*by, "feature").agg(F.sum(F.col("__g") / F.col("__all")).alias("__s"))
    totals = shares.groupBy(*by).agg(F.sum("__s").alias("__all"), F.collect_list(F.struct("feature", "__s")).alias("__e"))
    return totals.select(*by, "__all", F.inline("__e")).select(*by, "feature", (F.col("__s") / F.col("__all")).alias("importance"))
