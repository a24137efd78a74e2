"""Token ids as patched frame-of-reference files.

A file is a Parquet table of segments. A segment holds whole documents: their ids and end positions (the document index),
the byte offset of every block (the block index) and the blocks. A block holds up to ``BLOCK`` token ids: the minimum is
subtracted, the rest is packed at the width that a percentile of the values needs, and the few that need more
are patched from a list of exceptions. Segments follow each other in ascending id order, so a reader finds a
document by its segment's range, and a block without unpacking those before it.

Text is dealt out by ranges of ids, then encoded, packed and written in one pass; reading back is a map without a shuffle.

Defined cases: a null or empty text has only the end id. A null doc_id comes first; rows of an equal id follow each other
by their text's hash. An empty table gives an empty file.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinlift.llm.common import spaced, split_words

BLOCK = 4_096
PERCENTILE = 98.0
SEGMENT_IDS = 1 << 18      # a segment is closed after so many ids; a longer document makes a longer one
END_ID = 0
AT_ONCE = 256              # new pieces that are looked at for white space together
CACHED = 800_000           # pieces of text whose ids a worker remembers

_HEAD = np.dtype([("base", "<u4"), ("n", "<u2"), ("width", "u1"), ("exceptions", "<u2")])
SCHEMA = ("part int, seq int, first_id long, n long, doc_ids array<long>, doc_ends array<int>, "
          "block_starts array<int>, payload binary")


def _pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, least first: every eight values fill ``width`` bytes."""
    n = len(values)
    eight = np.zeros((-(-n // 8), 8), np.uint64)
    eight.ravel()[:n] = values & np.uint32((1 << width) - 1)
    words = np.zeros((len(eight), width // 8 + 1), "<u8")
    for j in range(8):
        word, bit = divmod(j * width, 64)
        words[:, word] |= eight[:, j] << np.uint64(bit)
        if bit + width > 64:
            words[:, word + 1] |= eight[:, j] >> np.uint64(64 - bit)
    return words.view(np.uint8)[:, :width].tobytes()[:(n * width + 7) // 8]


def _unpack(packed: np.ndarray, n: int, width: int) -> np.ndarray:
    groups = -(-n // 8)
    raw = np.zeros(groups * width, np.uint8)
    raw[:len(packed)] = packed
    held = np.zeros((groups, 8 * (width // 8 + 1)), np.uint8)
    held[:, :width] = raw.reshape(groups, width)
    words = held.view("<u8")
    eight = np.empty((groups, 8), np.uint32)
    for j in range(8):
        word, bit = divmod(j * width, 64)
        value = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            value |= words[:, word + 1] << np.uint64(64 - bit)
        eight[:, j] = value & np.uint64((1 << width) - 1)
    return eight.ravel()[:n]


def pack_block(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of at most 65,535 unsigned 32-bit values."""
    base = int(values.min())
    rest = (values - base).astype(np.uint32)
    k = int(np.ceil(percentile / 100 * (len(rest) - 1)))
    width = int(np.partition(rest, k)[k]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    head = np.array((base, len(values), width, len(over)), _HEAD)
    return b"".join([head.tobytes(), over.astype("<u2").tobytes(), rest[over].astype("<u4").tobytes(), _pack(rest, width)])


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    head = np.frombuffer(data, _HEAD, 1, at)[0]
    n, width, k = int(head["n"]), int(head["width"]), int(head["exceptions"])
    at += _HEAD.itemsize
    over = np.frombuffer(data, "<u2", k, at)
    patch = np.frombuffer(data, "<u4", k, at + 2 * k)
    values = _unpack(np.frombuffer(data, np.uint8, (n * width + 7) // 8, at + 6 * k), n, width)
    values[over] = patch
    return values + head["base"]


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable bytes as they are, others from 256 upwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Encoder:
    """Token ids of whole texts by a byte-level tokenizer file.

    Texts are cut where no token can cross. Pieces seen before are looked up; new ones are split by the file's pattern,
    and the library's model merges each new word. With ``added``, a text that contains an added token's string (such as
    ``<|endoftext|>``) is encoded by the library as a whole; without, such a string is ordinary text.
    """

    _shared: dict[tuple[str, str, bool], Encoder] = {}

    def __init__(self, path: str, pattern: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        tokens = self.library.get_added_tokens_decoder().values() if added else ()
        self.added = [t.content for t in tokens]
        self.pattern = split_words(pattern)
        self.letters = dict(enumerate(_byte_letters()))
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}                  # by the piece without its leading space

    @classmethod
    def of(cls, path: str, pattern: str, added: bool = False) -> Encoder:
        """One per worker process, so that pieces are remembered from task to task."""
        if (path, pattern, added) not in cls._shared:
            cls._shared[path, pattern, added] = cls(path, pattern, added)
        return cls._shared[path, pattern, added]

    def _learn(self, words: set[str]) -> None:
        """The library's ids of words not met before."""
        table, letters, tokenize = self.words, self.letters, self.model.tokenize
        new = list(words.difference(table))
        # one translation for all: a zero byte's letter parts the words, so those that hold one go by themselves
        several = [w for w in new if "\0" not in w]
        if several:
            written = "\0".join(several).encode().decode("latin-1").translate(letters).split(letters[0])
            tokens = list(map(tokenize, written))
            ends = np.cumsum([0, *map(len, tokens)]) * 4
            blob = array("I", [t.id for ts in tokens for t in ts]).tobytes()
            table.update(zip(several, [blob[a:b] for a, b in pairwise(ends.tolist())], strict=True))
        for w in words.difference(table):
            table[w] = array("I", [t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))]).tobytes()

    def _ids(self, pieces: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(p) for p in pieces]
        self._learn(set(chain.from_iterable(cut)))
        return [b"".join(map(self.words.__getitem__, ws)) for ws in cut]

    def _know(self, new: set[str]) -> None:
        """Remembers pieces. Those without any white space are split in one go: only their first words start with a space."""
        plain, other, every = [], [], list(new)
        for i in range(0, len(every), AT_ONCE):
            some = every[i:i + AT_ONCE]
            if " ".join(some).split() == some:
                plain += some
            else:
                for p in some:
                    (plain if p.split() == [p] else other).append(p)
        self.known.update(zip(other, self._ids([" " + p for p in other])))
        if plain:
            words = self.pattern.findall(" " + " ".join(plain))
            self._learn(set(words))
            coded = list(map(self.words.__getitem__, words))
            ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
            first = np.flatnonzero(np.fromiter((w[0] == " " for w in words), bool, len(words)))
            ends = [0, *ends[first[1:] - 1].tolist(), int(ends[-1])]
            blob = b"".join(coded)
            self.known.update(zip(plain, [blob[a:b] for a, b in zip(ends, ends[1:])], strict=True))

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        whole = {i for a in self.added for i, t in enumerate(batch) if a in t}
        if whole:
            rest = iter(self._encode([t for i, t in enumerate(batch) if i not in whole]))
            return [array("I", self.library.encode(t, add_special_tokens=False).ids).tobytes() if i in whole else next(rest)
                    for i, t in enumerate(batch)]
        return self._encode(batch)

    def _encode(self, batch: list[str]) -> list[bytes]:
        cut = [spaced(t) for t in batch]
        if len(self.known) > CACHED:
            self.known.clear()
            self.words.clear()
        heads = self._ids([pieces[0] for pieces in cut])
        known, out, late = self.known.__getitem__, [], []
        for i, pieces in enumerate(cut):         # a text of known pieces takes one look at each; the others' new ones are learned at once
            try:
                out.append(heads[i] + b"".join(map(known, islice(pieces, 1, None))))
            except KeyError:
                out.append(b"")
                late.append(i)
        self._know(set(chain.from_iterable(islice(cut[i], 1, None) for i in late)).difference(self.known))
        for i in late:
            out[i] = heads[i] + b"".join(map(known, islice(cut[i], 1, None)))
        return out


def _segment(part: int, seq: int, first: int, docs: list[tuple[int | None, np.ndarray]]) -> dict:
    ids = np.concatenate([x for _, x in docs])
    blocks = [pack_block(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    return {"part": part, "seq": seq, "first_id": first, "n": len(ids), "doc_ids": [d for d, _ in docs],
            "doc_ends": np.cumsum([len(x) for _, x in docs]).tolist(),
            "block_starts": np.cumsum([0, *map(len, blocks[:-1])]).tolist(), "payload": b"".join(blocks)}


def write(docs: DataFrame, path: str, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text",
          added: bool = False) -> None:
    """Encodes every row of ``docs`` and writes the file; ``added``: strings of added tokens become these tokens."""
    frame = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    ordered = frame.repartitionByRange("id").sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        encoder = Encoder.of(tokenizer, pattern, added)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            while some := list(islice(pairs, 512)):
                for (key_, _), ids in zip(some, encoder.encode([t or "" for _, t in some])):
                    yield key_, np.frombuffer(ids + end, "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        held, n, seq, first = [], 0, 0, 0
        for row in rows(batches):
            held.append(row)
            n += len(row[1])
            if n >= SEGMENT_IDS:
                yield pa.RecordBatch.from_pylist([_segment(part, seq, first, held)], _ARROW)
                held, n, seq, first = [], 0, seq + 1, first + n
        if held:
            yield pa.RecordBatch.from_pylist([_segment(part, seq, first, held)], _ARROW)

    ordered.mapInArrow(run, SCHEMA).write.mode("overwrite").parquet(path)


_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("n", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int32())),
                    ("block_starts", pa.list_(pa.int32())), ("payload", pa.binary())])


def read_segment(row: dict, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a segment; the block index tells which blocks to unpack."""
    stop = row["n"] if stop is None else stop
    blocks = range(start // BLOCK, -(-stop // BLOCK))
    got = [unpack_block(row["payload"], row["block_starts"][b]) for b in blocks]
    ids = np.concatenate(got) if got else np.zeros(0, np.uint32)
    return ids[start - blocks.start * BLOCK:stop - blocks.start * BLOCK]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of a file, ids as little-endian unsigned 32-bit integers."""
    return _documents(spark, path, lambda ids: ids.tobytes(), "ids binary", pa.binary())


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a file, from its unpacked ids."""
    return _documents(spark, path, lambda ids: zlib.crc32(ids), "ids_crc32 long", pa.int64())


def _documents(spark: SparkSession, path: str, digest, field: str, kind: pa.DataType) -> DataFrame:
    file = spark.read.schema(SCHEMA).parquet(path)
    # one row per task that wrote: how many ids come before its part
    parts = file.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = file.join(F.broadcast(parts), "part").select("n", F.col("first_id") + F.col("before"), "doc_ids", "doc_ends",
                                                          "block_starts", "payload")
    name = field.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, first, doc_ids, ends, starts, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids = read_segment({"n": n, "block_starts": starts, "payload": payload}).astype("<u4")
                begins = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array([first + b for b in begins], pa.int64()),
                     pa.array([e - b for b, e in zip(begins, ends)], pa.int64()),
                     pa.array([digest(ids[b:e]) for b, e in zip(begins, ends)], kind)],
                    ["doc_id", "start", "n_tokens", name])

    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {field}")
