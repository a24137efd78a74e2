"""Embedding whitening along leading components found by spectrum slicing.

Vectors become whole numbers; the fit list has each distinct one once. Spark adds up its size and sums exactly, then its
centred products (segments of one matrix per task, ``functions.blocks``). The covariance is as large as the vectors are
wide, not as the table is long, so its leading eigenvalues are found on the driver:

* an LDL' factorisation of the shifted covariance (diagonal pivots of one or two rows) has as many positive eigenvalues as the covariance has
  eigenvalues above the shift, so bisection by these counts isolates each leading eigenvalue;
* Rayleigh quotient iteration converges cubically to its vector; an answer outside the isolating interval is
  thrown away and the interval halved again;
* the counts at both ends of its interval certify a value's number. Values that no shift can tell apart share an
  orthonormal basis of their space.

A last pass projects every row. ``identity_error`` is measured on the whitened fit list itself.

Defined cases: a row with a null vector, an empty one, or a null or non-finite entry is left out; so is one with an entry whose scaled value
is no long. Other rows, repeated ids among them, each have their result; a null id stays null. Vectors of each width are a fit of their
own. Components without variance (beyond the rank, or a fit list of one vector) have no rows. A deviation that no long can hold is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlift.functions.blocks import add_segments, joined, segments
from joinlift.llm.common import store

COMPONENTS = 4
SCALE = 256
BATCH_NUMBERS = 2 ** 20     # numbers of a batch that are held as doubles at once
PIVOT = (1 + 17 ** 0.5) / 8  # fixed value: growth bound of the symmetric pivoting
CLOSE = 64                  # eigenvalues nearer than this many rounding errors of the largest are one
LONG = 2 ** 63


# the spectrum of a symmetric matrix

def inertia(a: np.ndarray) -> int:
    """How many eigenvalues of the symmetric matrix are positive: the positive pivots of its LDL' factorisation (Sylvester)."""
    a = np.array(a, np.float64)
    n, above, k = len(a), 0, 0
    while k < n:
        d = np.abs(np.diagonal(a)[k:])
        if k == n - 1:
            return above + int(a[k, k] > 0)
        lower = np.abs(np.tril(a[k:, k:], -1))
        big = lower.max()
        if d.max() == 0 and big == 0:
            return above
        if d.max() >= PIVOT * big:                       # one row: the largest diagonal entry
            _swap(a, k, k + int(d.argmax()))
            p = a[k, k]
            above += int(p > 0)
            c = a[k + 1:, k].copy()
            a[k + 1:, k + 1:] -= np.outer(c, c / p)
            k += 1
        else:                                            # two rows about the largest other entry: one eigenvalue of each sign
            r, s = divmod(int(lower.argmax()), n - k)
            _swap(a, k, k + s)
            _swap(a, k + 1, k + r)
            above += 1
            c = a[k + 2:, k:k + 2].copy()
            a[k + 2:, k + 2:] -= c @ np.linalg.solve(a[k:k + 2, k:k + 2], c.T)
            k += 2
    return above


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


class Slicer:
    """Leading eigenpairs of a symmetric positive semidefinite matrix, numbered by counts."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.n = len(v)
        self.top = float(np.abs(v).sum(axis=1).max()) if self.n else 0.0
        self.tiny = CLOSE * np.finfo(float).eps * self.top * max(1.0, self.n ** 0.5)
        self.counts: dict[float, int] = {self.top * (1 + 1e-12) + self.tiny: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = inertia(self.v - shift * np.eye(self.n))
        return self.counts[shift]

    def bracket(self, number: int) -> tuple[float, float]:
        """Shifts seen so far with fewer than ``number`` eigenvalues above the upper and at least ``number`` above the lower."""
        high = min(s for s, c in self.counts.items() if c < number)
        low = max((s for s, c in self.counts.items() if c >= number), default=-self.tiny)
        return low, high

    def pair(self, number: int, found: np.ndarray) -> tuple[float, np.ndarray]:
        """The ``number``-th largest eigenvalue and its unit vector, which is orthogonal to the rows of ``found``."""
        while True:
            low, high = self.bracket(number)
            alone = low in self.counts and self.above(low) - self.above(high) == 1
            narrow = high - low <= self.tiny
            if alone or narrow:
                value, vector = self.refine(low, high, found, narrow)
                # an eigenvalue in the bracket is certified by the bracket's own counts
                if narrow or (low <= value <= high and np.linalg.norm(self.v @ vector - value * vector) <= self.tiny):
                    return value, vector
            self.above((low + high) / 2)

    def refine(self, low: float, high: float, found: np.ndarray, narrow: bool) -> tuple[float, np.ndarray]:
        """Inverse iteration at the middle for a start, then Rayleigh quotient iteration until the quotient stands still."""
        x = self.clear(np.cos(1.0 + np.arange(self.n) ** 2), found)     # fixed start, along no axis
        shift = (low + high) / 2
        for _ in range(3):
            x = self.clear(self.solve(shift, x), found)
        value = float(x @ self.v @ x)
        for _ in range(60 if not narrow else 3):
            y = self.clear(self.solve(value, x), found)
            now = float(y @ self.v @ y)
            x, value, last = y, now, value
            if abs(now - last) <= np.finfo(float).eps * self.top / 4:
                break
        x = self.clear(self.solve(value, x), found)                     # one more step: the vector follows the value
        return float(x @ self.v @ x), x

    def clear(self, x: np.ndarray, found: np.ndarray) -> np.ndarray:
        for _ in range(2):
            if len(found):
                x = x - found.T @ (found @ x)
            x = x / np.linalg.norm(x)
        return x

    def solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        for bump in (0.0, 1e-16, 1e-15, 1e-14, 1e-12):
            try:
                y = np.linalg.solve(self.v - (shift + bump * (self.top or 1.0)) * np.eye(self.n), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all():
                return y
        return x


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as rows) of up to k leading components with variance, by falling value."""
    at = Slicer(v)
    values, vectors = [], np.zeros((0, at.n))
    for number in range(1, min(k, at.n) + 1):
        if at.above(at.tiny) < number:                   # the rest is rounding
            break
        value, x = at.pair(number, vectors)
        values.append(value)
        vectors = np.vstack([vectors, x])
    return np.array(values), vectors


# Spark: whole vectors, sums, products, projection

def _vectors(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """(ids, width, whole-number matrix) of the usable rows of (id, vector) batches."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        flat = lists.flatten()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        x = np.floor(flat.cast(pa.float64()).to_numpy(zero_copy_only=False) * float(scale))     # a null entry is NaN
        bad = np.concatenate([[0], np.cumsum(~(np.abs(x) < LONG))])
        fine = (sizes > 0) & (bad[ends] == bad[ends - sizes])
        for width in np.unique(sizes[fine]).tolist():
            rows = np.flatnonzero(fine & (sizes == width))
            step = max(1, BATCH_NUMBERS // width)
            for some in (rows[i:i + step] for i in range(0, len(rows), step)):
                at = (ends[some] - width)[:, None] + np.arange(width)
                yield ids.take(pa.array(some)), width, x[at].astype(np.int64)


def _whole(table: DataFrame, key: str, vector: str) -> DataFrame:
    return table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))


def distinct_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(width, x): each distinct whole-number vector once, as little-endian longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, width, x in _vectors(batches, scale):
            x = np.unique(x, axis=0) if len(x) > 1 else x
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), width, np.int32)), pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())],
                                             ["width", "x"])
    return _whole(table, key, vector).mapInArrow(run, "width int, x binary").distinct()


def _by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, matrix) of the rows of (width, x) batches, some rows at a time."""
    for batch in batches:
        widths = batch.column(0).to_numpy()
        xs = batch.column(1)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            step = max(1, BATCH_NUMBERS // width)
            for i in range(0, len(rows), step):
                yield width, np.frombuffer(b"".join(xs.take(pa.array(rows[i:i + step])).to_pylist()), "<i8").reshape(-1, width)


def column_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per width: how many vectors, and the exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for width, x in _by_width(batches):
            n, high, low = held.get(width, (0, 0, 0))
            # halves of 32 bits, so that a sum over 2^31 rows cannot overflow
            held[width] = (n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0))
        for width, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width, width, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n, np.int64)),
                 pa.array(high), pa.array(low)], ["width", "i", "n", "high", "low"])
    parts = fit.select("width", "x").mapInArrow(run, "width int, i int, n long, high long, low long")
    sums = parts.groupBy("width", "i").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    got: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("width", "i").collect():           # one row per dimension
        got.setdefault(r["width"], (r["n"], []))[1].append((int(r["high"]) << 32) + int(r["low"]))
    return got


def deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where they fit, else Python's whole numbers."""
    largest = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, s), default=0)
    if largest < LONG:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def squared(d: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None where it is no long."""
    if d.dtype != object and d.shape[1] * float(np.abs(d).max(initial=0)) ** 2 < 2.0 ** 62:
        return (d * d).sum(axis=1).tolist()
    sums = (int((r.astype(object) ** 2).sum()) for r in d)
    return [v if v < LONG else None for v in sums]


def _summed(fit: DataFrame, of: Callable[[int, np.ndarray], np.ndarray | None]) -> dict[int, np.ndarray]:
    """Per width: the flattened sum over the fit list of ``of(width, x)``, a matrix of fixed shape, merged in segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for width, x in _by_width(batches):
            part = of(width, x)
            if part is not None:
                held[width] = part if width not in held else held[width] + part
        for width, total in held.items():
            rows = list(segments(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), width, np.int32)), pa.array([p for p, _ in rows], pa.int32()),
                                              pa.array([b for _, b in rows], pa.binary())], ["width", "place", "part"])
    merged = add_segments(fit.select("width", "x").mapInArrow(run, "width int, place int, part binary"), ["width", "place"])
    got: dict[int, list] = {}
    for r in merged.collect():                               # a square of the width
        got.setdefault(r["width"], []).append((r["place"], bytes(r["part"])))
    return {w: joined(*zip(*parts)) for w, parts in got.items()}


def covariances(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per width: the covariance (divisor n); vectors are centred exactly before they are multiplied."""
    def products(width: int, x: np.ndarray) -> np.ndarray:
        n, s = sums[width]
        z = deviations(x, n, s).astype(np.float64) / n
        return z.T @ z
    return {w: m.reshape(w, w) / sums[w][0] for w, m in _summed(fit, products).items()}


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable row of the table and component."""
    fit = store(distinct_vectors(table, key, vector, scale))
    sums = column_sums(fit)
    model = {}
    for width, v in covariances(fit, sums).items():
        values, vectors = leading(v, components)
        model[width] = (values, (vectors / np.sqrt(values)[:, None]).T if len(values) else np.zeros((width, 0)), float(np.trace(v)))

    def project(width: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, s = sums[width]
        d = deviations(x, n, s)
        return d, (d.astype(np.float64) / n) @ model[width][1]

    def whitened_products(width: int, x: np.ndarray) -> np.ndarray | None:
        y = np.column_stack([np.ones(len(x)), project(width, x)[1]])
        return y.T @ y if y.shape[1] > 1 else None

    errors = {}
    for width, flat in _summed(fit, whitened_products).items():
        k = len(model[width][0])
        g = flat.reshape(k + 1, k + 1) / sums[width][0]
        errors[width] = float(np.abs(g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, width, x in _vectors(batches, scale):
            values, _, trace = model[width]
            d, y = project(width, x)
            k, rows = len(values), len(x)
            if not k:
                continue
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, sums[width][0], np.int64)), pa.array(squared(d), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                 pa.array(y.ravel()), pa.array(np.tile(values / trace, rows)), pa.array(np.full(rows * k, errors[width]))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _whole(table, key, vector).mapInArrow(
        run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
