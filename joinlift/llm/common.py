"""Helpers shared by the operators: texts as bytes, stored intermediates, joins that survive hot keys."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlift.functions.spread import materialise as store  # noqa: F401  a Parquet table in the shared folder

BROADCAST_ROWS = 200_000     # a lookup table up to this many rows is broadcast
HOT_SHARE = 1_000            # a key with more than 1/HOT_SHARE of the weight is hot: fewer than HOT_SHARE keys are

#: Between a non-space and a single space before a non-space: no match of the byte-level split pattern crosses this place.
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")
_OTHER_SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f"
_RARE_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def spaced(text: str) -> list[str]:
    """The text cut before single spaces, where tokens never cross: its head, then pieces without their leading space."""
    odd = any(c in text and (" " + c in text or c + " " in text) for c in _OTHER_SPACES) or "  " in text
    if not odd and (text.isascii() or _RARE_SPACES.search(text) is None):
        return text.split(" ")             # every space stands alone between other characters
    head, *rest = _BETWEEN.split(text)
    return [head, *(p[1:] for p in rest)]


def split_words(pattern: str) -> regex.Pattern:
    """The pattern with Unicode's White_Space for its spaces; Python's own class has four control characters more."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


def lookup_join(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of one-row-per-key values that no hot key can slow down.

    ``table`` must be stored; ``weight`` says how many rows each key has. A small table is broadcast
    behind a count. Beyond that, only the hot keys are broadcast (fewer than HOT_SHARE by arithmetic)
    and the remaining rows, among which no key is frequent, are joined by shuffle.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table.drop(weight)), key, "left")
    total = table.agg(F.sum(weight)).first()[0]
    hot = table.where(F.col(weight) * HOT_SHARE > F.lit(total)).drop(weight)
    is_hot = rows.join(F.broadcast(hot), key, "inner")
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.drop(weight), key, "left")
    return is_hot.unionByName(others)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array, and the n + 1 offsets into it, without copying a text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``most`` bytes; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def with_columns(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], [*batch.schema.names, *new])


def position(frame: DataFrame, name: str) -> int:
    """Where a column stands; batches are read by position, so other columns may have any name."""
    return [c.lower() for c in frame.columns].index(name.lower())
