"""Quality classifier: histogram gradient-boosted trees over statistics of each document's whole text.

The trees are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, chosen by hash), which is the only thing
that reaches the driver. Scoring is one pass over the texts: statistics, then all trees at once, as flat arrays.

Defined cases: a null text is an empty text; empty texts are scored like any other; repeated rows get equal scores.
Repeated labels of one id count as their largest. A null label is no label. Without any usable label the score is 0.5.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlift.llm.common import position, texts

SAMPLE_ROWS = 30_000       # labelled rows that the trees are fitted on, at most
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
SHRINK = 5.0               # added to the sum of hessians of a leaf
CUT = 0.7

_LETTER, _DIGIT, _SPACE, _MARK, _SYMBOL, _HIGH = range(6)
_CLASS = np.array([_HIGH if b >= 128 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit()
                   else _SPACE if b in b" \t\n\r\v\f" else _MARK if b in b".,;:!?'\"()-" else _SYMBOL
                   for b in range(256)], np.uint8)
FEATURES = ("log_bytes", "log_words", "word_len", "longest_word", "distinct_words", "top_word", "top_five_words",
            "repeats_next", "distinct_pairs", "letters", "digits", "spaces", "marks", "symbols", "high", "upper",
            "symbol_words", "short_words", "capital_words", "log_lines", "distinct_lines", "line_words",
            "ended_lines", "short_lines", "compressed", "byte_entropy")


def statistics(text: bytes) -> list[float]:
    """The features of one whole text; for an empty one all are zero."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    byte_counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, weights=byte_counts, minlength=6) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(5)]
    after = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    k = max(len(lines), 1)
    p = byte_counts[byte_counts > 0] / size
    return [np.log1p(size), np.log1p(n), lengths.mean(), lengths.max(), len(counts) / n, top[0] / n, sum(top) / n,
            after / n, pairs / max(n - 1, 1), *classes, byte_counts[65:91].sum() / size,
            sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,;:!?'\")-" for w in words) / n,
            float((lengths <= 2).mean()), sum(65 <= w[0] <= 90 for w in words) / n,
            np.log1p(len(lines)), len(set(lines)) / k, n / k,
            sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"', b":", b";") for x in lines) / k,
            sum(len(x) < 30 for x in lines) / k, len(zlib.compress(text, 1)) / size, float(-(p * np.log2(p)).sum())]


def feature_matrix(column: pa.Array) -> np.ndarray:
    rows = [statistics(t) for t in texts(column)]
    return np.array(rows, np.float64).reshape(len(rows), len(FEATURES))


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth as flat arrays: node i has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray        # (trees, 2^depth - 1)
    cut: np.ndarray            # same shape; a value above the cut goes right
    leaf: np.ndarray           # (trees, 2^depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosting on the logistic loss; splits are searched over histograms of quantile bins."""
    n, width = x.shape
    inner, leaves = 2 ** depth - 1, 2 ** depth
    share = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    feature, cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if n == 0:
        return Trees(base, feature, cut, leaf)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)   # v <= edge: bin of it
    cells = bins + np.arange(width) * BINS
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            first, count = 2 ** d - 1, 2 ** d
            at = ((node - first)[:, None] * (width * BINS) + cells).ravel()
            shape = (count, width, BINS)
            gs = np.bincount(at, np.repeat(g, width), count * width * BINS).reshape(shape).cumsum(axis=2)
            hs = np.bincount(at, np.repeat(h, width), count * width * BINS).reshape(shape).cumsum(axis=2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs ** 2 / (hs + SHRINK) + (g_all - gs) ** 2 / (h_all - hs + SHRINK) - g_all ** 2 / (h_all + SHRINK)
            best = gain.reshape(count, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            for i in range(count):
                if b[i] < len(edges[f[i]]) and gain[i, f[i], b[i]] > 1e-9:
                    feature[t, first + i], cut[t, first + i] = f[i], edges[f[i]][b[i]]
            here = node - first
            goes = x[np.arange(n), feature[t, first + here]] > cut[t, first + here]
            node = 2 * node + 1 + goes
        at = node - inner
        leaf[t] = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + SHRINK)
        margin += leaf[t][at]
    return Trees(base, feature, cut, leaf)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str, key: str,
                    rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``rows`` labelled documents, chosen by a hash of their id."""
    drawn = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
             .groupBy(F.col(key).alias("__id")).agg(F.max(F.col(label).cast("double")).alias("y"))
             .orderBy(F.xxhash64("__id"), "__id").limit(rows))
    chosen = docs.select(F.col(key).alias("__id"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(drawn), "__id").select("__id", "text", "y")                # at most ``rows`` rows are broadcast

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix(batch.column(1))
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), packed], ["id", "y", "x"])

    measured = chosen.mapInArrow(measure, "id long, y double, x binary")
    got = measured.orderBy(F.xxhash64("id"), "id", "x").limit(rows).toArrow()  # repeated ids don't lift the bound
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float64).reshape(-1, len(FEATURES))
    return x, got["y"].to_numpy(zero_copy_only=False).astype(float)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS) -> Trees:
    return fit_trees(*labelled_sample(docs, labels, label, text, key, sample_rows))


def score(docs: DataFrame, model: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` without its text, with a score per row."""
    kept = [c for c in docs.columns if c != text]
    frame = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in frame.dtypes[:-1]), f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array(model.score(feature_matrix(batch.column(batch.num_columns - 1))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], got], [*kept, name])

    return frame.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Trees, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score at least ``cut``, as they are."""
    at = position(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(feature_matrix(batch.column(at))) >= cut))

    return docs.mapInArrow(run, docs.schema)
