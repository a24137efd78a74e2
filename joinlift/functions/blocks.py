"""Sums of matrices that many tasks hold a part of, shipped in segments so that no row, batch or group is ever large.

A task cuts what it has summed into segments of whole rows, about ``SEGMENT`` numbers each. Segments of one key and place are added
one after another from a sorted stream, first within ``SALTS`` salts, then across them: a task holds one segment at a time
however many tasks took part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1024
SALTS = 16


def segments(matrix: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(place, little-endian doubles) of a matrix, whole rows of it at a time; a longer row is a segment of its own."""
    matrix = np.ascontiguousarray(matrix, "<f8")
    step = max(1, SEGMENT // max(1, matrix.shape[1]))
    for s in range(0, len(matrix), step):
        yield s // step, matrix[s:s + step].tobytes()


def joined(places: Sequence[int], parts: Sequence[bytes]) -> np.ndarray:
    """The flattened matrix of all its segments, given in any order."""
    return np.concatenate([np.frombuffer(p, "<f8") for _, p in sorted(zip(places, parts))])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the last column of consecutive rows that agree in all others."""
    names, kinds, key, total, done = None, None, None, None, []

    def flush():
        columns = list(zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
    for batch in batches:
        names, kinds = batch.schema.names, batch.schema.types
        for *now, part in zip(*(c.to_pylist() for c in batch.columns)):
            part = np.frombuffer(part, "<f8")
            if key is not None and now == key:
                total += part
                continue
            if key is not None:
                done.append((*key, total.tobytes()))
            key, total = now, part.copy()
        if len(done) >= 4096:
            yield flush()
            done.clear()
    if key is not None:
        done.append((*key, total.tobytes()))
    if done:
        yield flush()


def add_segments(partial: DataFrame, keys: Sequence[str], part: str = "part") -> DataFrame:
    """One row per ``keys``: the elementwise sum of its segments ``part`` (all of one length). Keys may be null."""
    schema = {f.name: f.dataType.simpleString() for f in partial.schema}
    salted = partial.select(*keys, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("__salt"), part)
    for by in ([*keys, "__salt"], list(keys)):
        text = ", ".join(f"`{k}` {schema.get(k, 'int')}" for k in by)
        salted = salted.select(*by, part).repartition(*by).sortWithinPartitions(*by).mapInArrow(
            _add_up, f"{text}, `{part}` binary")
    return salted
