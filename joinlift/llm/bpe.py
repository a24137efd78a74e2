"""Byte-level BPE by recursive queries: encoding to a fixpoint of merges, and decoding by ordered aggregation.

Each task keeps one in-memory DuckDB with two tables of fixed size, the merges and the vocabulary. Words
that the task hasn't met are encoded there by a recursive query: every step joins a word's neighbouring tokens with the
merge table and contracts the leftmost pair of minimum rank; a word drops out when no pair is left. The recursion
keeps one state per word, so memory stays in proportion to the words, however long they are. Decoding joins
token positions with the vocabulary and aggregates them in order.

Defined cases: a null or empty text has no ids; its digests are those of no bytes. Every other text decodes to itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlift.llm.common import slices, spaced, split_words

CACHED_BYTES = 48 << 20    # of pieces and words, and of their ids, that a worker remembers; about a quarter of what they take in memory
WORDS_AT_ONCE = 20_000
DOCS_BYTES = 1 << 20       # texts per round trip, unless one is longer
DECODE_IDS = 1 << 17       # ids per round trip, unless one text has more

_ENCODE = """
WITH RECURSIVE state(word, toks) USING KEY (word) AS (
    SELECT word, toks FROM words
  UNION
    (WITH pairs AS (
        SELECT word, pos, toks[pos] AS a, toks[pos + 1] AS b
        FROM (SELECT word, toks, unnest(range(1, len(toks))) AS pos FROM state)
     ), best AS (
        SELECT word, min((id::BIGINT << 32) | pos) AS least FROM pairs JOIN merges USING (a, b) GROUP BY word
     )
     SELECT word, list_concat(list_append(toks[:(least & 4294967295) - 1], (least >> 32)::INTEGER),
                              toks[(least & 4294967295) + 2:])
     FROM state JOIN best USING (word))
)
SELECT array_to_string(toks, ',') AS ids FROM state ORDER BY word
"""

# one sort of all positions by a 64-bit key instead of one per group; the one thread aggregates rows in that order
_DECODE = """
SELECT doc, string_agg(bytes, '') AS text
FROM (SELECT doc, bytes
      FROM (SELECT doc, unnest(ids) AS id, (doc::BIGINT << 32) | generate_subscripts(ids, 1) AS pos FROM docs)
      JOIN vocabulary USING (id) ORDER BY pos)
GROUP BY doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """The merges of one rank file in a database of its own process."""

    _shared: dict[tuple[str, str], Coder] = {}

    def __init__(self, path: str, pattern: str):
        import duckdb
        ranks = load_ranks(path)
        self.pattern = split_words(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks = ranks
        splits = [(ranks[t[:i]], ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t))
                  if t[:i] in ranks and t[i:] in ranks]
        a, b, c = (pa.array(x, pa.int32()) for x in zip(*splits))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.db.register("m", pa.table({"a": a, "b": b, "id": c}))
        self.db.register("v", pa.table({"id": pa.array(list(ranks.values()), pa.int32()),
                                        "bytes": [t.decode("latin-1") for t in ranks]}))
        self.db.execute("CREATE TABLE merges AS FROM m; CREATE TABLE vocabulary AS FROM v")
        self.words: dict[str, str] = {}
        self.known: dict[str, str] = {}                    # by the piece without its leading space
        self.size = 0                                      # bytes of both

    @classmethod
    def of(cls, path: str, pattern: str) -> Coder:
        """One per worker process, so that words are remembered from task to task."""
        if (path, pattern) not in cls._shared:
            cls._shared[path, pattern] = cls(path, pattern)
        return cls._shared[path, pattern]

    def _merge(self, words: list[str]) -> None:
        """Ids of new words: a word of the vocabulary is its id, the others are merged from bytes."""
        rest = []
        for w in words:
            whole = self.ranks.get(w.encode())
            if whole is None:
                rest.append(w)
            else:
                self.words[w] = str(whole)
        for i in range(0, len(rest), WORDS_AT_ONCE):
            some = rest[i:i + WORDS_AT_ONCE]
            raw = [w.encode() for w in some]
            ends = np.cumsum([0, *map(len, raw)])
            toks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                            pa.array(self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]))
            self.db.register("words", pa.table({"word": pa.array(range(len(some)), pa.int32()), "toks": toks}))
            ids = self.db.sql(_ENCODE).to_arrow_table().column(0).to_pylist()
            self.words.update(zip(some, ids))
            self.size += int(ends[-1]) + sum(map(len, ids))

    def _words(self, pieces: list[str]) -> list[str]:
        """Decimal ids of pieces of text: each match of the pattern by itself."""
        cut = [self.pattern.findall(p) for p in pieces]
        self._merge(list({w for ws in cut for w in ws}.difference(self.words)))
        known = self.words
        return [known[ws[0]] if len(ws) == 1 else ",".join([known[w] for w in ws]) for ws in cut]

    def encode(self, batch: list[str]) -> list[str]:
        """Decimal ids of each text, joined by commas."""
        cut = [spaced(t) for t in batch]
        if self.size > CACHED_BYTES:
            self.known.clear()
            self.words.clear()
            self.size = 0
        new = list({p for pieces in cut for p in pieces[1:]}.difference(self.known))
        ids = self._words([" " + p for p in new])
        self.known.update(zip(new, ids))
        self.size += sum(map(len, new)) + sum(map(len, ids))
        known = self.known
        heads = self._words([pieces[0] for pieces in cut])
        return [",".join([*([head] if head else []), *[known[p] for p in pieces[1:]]]) for head, pieces in zip(heads, cut)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids."""
        out = [b""] * len(ids)
        ends = np.cumsum([0, *map(len, ids)])
        for i, j in slices(ends, DECODE_IDS):
            lists = pa.ListArray.from_arrays(pa.array(ends[i:j + 1] - ends[i], pa.int32()),
                                             pa.array(np.concatenate(ids[i:j]).astype(np.int32)))
            self.db.register("docs", pa.table({"doc": pa.array(range(i, j), pa.int32()), "ids": lists}))
            for doc, text in self.db.execute(_DECODE).fetchall():
                out[doc] = text.encode("latin-1")
        return out


def parse(joined: str) -> np.ndarray:
    return np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32)


def _runs(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch, about DOCS_BYTES at a time, with the place of the first."""
    held, size, first = [], 0, 0
    for i, t in enumerate(batch.column(at).to_pylist()):
        held.append(t or "")
        size += len(held[-1])
        if size >= DOCS_BYTES:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _map(docs: DataFrame, text: str, kept: list[str], fields: dict[str, tuple[str, pa.DataType]], path: str, pattern: str,
         make: Callable[[Coder, list[str]], list[list]]) -> DataFrame:
    frame = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in frame.dtypes[:-1]), *(f"{n} {t}" for n, (t, _) in fields.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern)
        for batch in batches:
            for first, some in _runs(batch, batch.num_columns - 1):
                new = [pa.array(x, kind) for x, (_, kind) in zip(make(coder, some), fields.values())]
                own = batch.slice(first, len(some)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*own, *new], [*kept, *fields])

    return frame.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` without its text, with the token ids."""
    kept = [c for c in docs.columns if c != text]
    return _map(docs, text, kept, {name: ("array<int>", pa.list_(pa.int32()))}, path, pattern,
                lambda coder, some: [[parse(x) for x in coder.encode(some)]])


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", name: str = "bytes") -> DataFrame:
    """``rows`` without its ids, with the bytes that they stand for (null ids: none)."""
    kept = [c for c in rows.columns if c != ids]
    frame = rows.select(*kept, F.col(ids).cast("array<int>").alias("__ids"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in frame.dtypes[:-1]), f"`{name}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = coder.decode([np.array(x or [], np.int32) for x in part.column(part.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.binary())], [*kept, name])

    return frame.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, n_tokens, and digests of its ids and of the bytes decoded from them."""
    def make(coder: Coder, some: list[str]) -> list[list]:
        joined = coder.encode(some)
        ids = [parse(x) for x in joined]
        back = coder.decode(ids)
        return [[len(x) for x in ids], [hashlib.sha256(x.encode()).hexdigest() for x in joined],
                [hashlib.sha256(x).hexdigest() for x in back]]

    return _map(docs, text, [key], {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()),
                                    "decoded_sha256": ("string", pa.string())}, path, pattern, make)
