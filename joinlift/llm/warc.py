"""WARC archives in seekable Zstandard bundles.

Each task writes its records into bundle files: records are grouped into frames of about ``FRAME_BYTES``, every frame is
compressed on its own, and a bundle ends with the seek table of the Zstandard seekable format (a skippable frame that any decoder passes over). The index, a
Parquet table beside the bundles, maps each record id to bundle, frame, offset within the frame and length, so ``fetch``
reads one frame per record wanted. The index is also the commit: bundles have names that no other attempt uses, and only rows of
tasks that succeeded are in it, so a bundle of a lost attempt is never read.

Of records with equal payloads (equal SHA-256 and length) of at least ``least`` bytes, that of the largest page id is the response; the others
are revisits without payload that name it. Equal payloads are counted by partial aggregation; no group of copies meets in a task.

Defined cases: a null html is an empty payload; a null or empty url gives a record without target address; a null page id sorts below
all others and stays null. Rows repeated under one page id with one payload are records of their own, one of which is the
response. Control characters in an address are percent-encoded. An empty table gives an archive without bundles.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlift.llm.common import lookup_join, store

FRAME_BYTES = 1 << 20       # of records, before compression; a longer record is a frame of its own
BUNDLE_BYTES = 256 << 20    # of compressed frames: a bundle that has reached this is closed
LEVEL = 3
ROWS = 256                  # records handled at once
TASK_FRAMES = 128           # at most this many frames a task when a large archive is read
#: Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORD = ("record_id string, page_id long, record_type string, uri string, payload_digest string, payload_bytes long, "
          "refers_to_record string, payload binary")


def file_system(where: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file and its path there."""
    local = re.fullmatch(r"(?:file:)?/*(/.*)", where)
    return (pafs.LocalFileSystem(), local.group(1)) if local else pafs.FileSystem.from_uri(where)


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# one record

def _address(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c.group()):02X}", url or "")


def record(row: dict, date: str) -> bytes:
    """A WARC/1.1 record; a revisit has the HTTP head alone."""
    payload = row["payload"]
    revisit = row["refers_to_record"] is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date)]
    if row["url"]:
        fields.append(("WARC-Target-URI", _address(row["url"])))
    if row["page_id"] is not None:
        fields.append(("X-Page-ID", str(row["page_id"])))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if revisit:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{row['refers_to_record']}>")]
    block = head if revisit else head + payload
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at ``at`` and where the next one starts."""
    if not data.startswith(b"WARC/1.", at):
        raise ValueError(f"no record at {at}")
    end = data.index(b"\r\n\r\n", at)
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    start = end + 4
    stop = start + int(fields["content-length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} has no end at {stop}")
    block = data[start:stop]
    http = block.index(b"\r\n\r\n") + 4
    refers = fields.get("warc-refers-to")
    found = {"record_id": fields["warc-record-id"].strip("<>"), "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None,
             "record_type": fields["warc-type"], "uri": fields.get("warc-target-uri"),
             "payload_digest": None, "payload_bytes": None, "refers_to_record": refers.strip("<>") if refers else None, "payload": None}
    if found["record_type"] == "response":               # measured on what the archive holds, and held against what it states
        payload = block[http:]
        found.update(payload=payload, payload_bytes=len(payload), payload_digest=digest(payload))
        if fields["warc-payload-digest"] != f"sha1:{found['payload_digest']}":
            raise ValueError(f"payload of {found['record_id']} does not have its digest")
    return found, stop + 4


# one bundle

class BundleWriter:
    """Frames, one after another, and the seek table at the end."""

    def __init__(self, folder: str):
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.entries: list[tuple[int, int]] = []
        self.size = 0

    def frame(self, data: bytes) -> int:
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data)))
        self.size += len(packed)
        return len(self.entries) - 1

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *e) for e in self.entries)
        footer = struct.pack("<IBI", len(self.entries), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


class BundleReader:
    """Any frame of a bundle by its number."""

    def __init__(self, folder: str, name: str):
        fs, path = file_system(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        table = self.file.read_at(frames * 8, size - 9 - frames * 8)
        self.entries = list(struct.iter_unpack("<II", table))
        self.starts = [0]
        for packed, _ in self.entries:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, i: int) -> bytes:
        packed, raw = self.entries[i]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[i]), max_output_size=raw)
        if len(data) != raw:
            raise ValueError(f"frame {i} has {len(data)} bytes, not {raw}")
        return data

    def close(self) -> None:
        self.file.close()


# the archive

def deduplicated(pages: DataFrame, key: str, url: str, html: str, least: int) -> DataFrame:
    """(page_id, url, payload, record_id, refers_to_record) of every row; the last is null for responses."""
    payload = F.coalesce(F.encode(F.col(html).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    # numbered once and stored, so that rows alike in everything stay apart in any retry
    rows = store(rows.withColumn("uid", F.monotonically_increasing_id())
                 .withColumn("sha", F.concat(F.sha2("payload", 256), F.lit("-"), F.length("payload"))))
    id_ = _uuid(F.md5(F.concat_ws("|", F.lit("page"), F.col("page_id"), "uid", "sha")))
    best = rows.where(F.length("payload") >= least).groupBy("sha").agg(
        F.max(F.struct("page_id", (-F.col("uid")).alias("uid"))).alias("first"), F.count(F.lit(1)).alias("n"))
    copied = store(best.where("n > 1").select("sha", "n", F.col("first.page_id").alias("__page"), (-F.col("first.uid")).alias("__uid")))
    met = lookup_join(rows, copied, "sha", "n")
    first = _uuid(F.md5(F.concat_ws("|", F.lit("page"), F.col("__page"), "__uid", "sha")))
    return met.select("page_id", "url", "payload", id_.alias("record_id"),
                      F.when(F.col("__uid") != F.col("uid"), first).alias("refers_to_record"))


def _uuid(hex_: Column) -> Column:
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(hex_, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
          date: str = "2020-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Writes an archive: ``path/bundles`` and ``path/index``."""
    folder = f"{path}/bundles"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, buffer, held = None, bytearray(), []

        def cut() -> pa.RecordBatch:
            frame = bundle.frame(bytes(buffer))
            rows = [(i, p, bundle.name, frame, at, n) for i, p, at, n in held]
            buffer.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                names=["record_id", "page_id", "bundle", "frame", "offset", "length"])
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                for row in batch.slice(start, ROWS).to_pylist():
                    data = record(row, date)
                    bundle = bundle or BundleWriter(folder)
                    if held and len(buffer) + len(data) > frame_bytes:
                        yield cut()
                        if bundle.size >= bundle_bytes:
                            bundle.close()
                            bundle = BundleWriter(folder)
                    held.append((row["record_id"], row["page_id"], len(buffer), len(data)))
                    buffer += data
        if held:
            yield cut()
        if bundle:
            bundle.close()

    deduplicated(pages, key, url, html, least).mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{path}/index")


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


_KINDS = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())


def _records(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``FRAME_BYTES`` of payload."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], t) for n, t in zip(names, _KINDS)], names=names)
    for r in found:
        held.append(r)
        size += r["payload_bytes"] or 0
        if len(held) >= 4 * ROWS or size >= FRAME_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive: whole frames are unpacked, parsed and checked, one at a time per task."""
    folder = f"{path}/bundles"
    frames = store(index(spark, path).groupBy("bundle", "frame").agg(F.count(F.lit(1)).alias("n")))
    count = frames.count()
    # the list of frames is small, the frames are not: neighbours go together, to a stated number of tasks
    tasks = max(1, min(count, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK_FRAMES))))
    frames = frames.repartitionByRange(tasks, "bundle", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                open_ = None
                for name, frame, n in sorted(zip(*(c.to_pylist() for c in batch.columns))):
                    if open_ is None or open_[0] != name:
                        if open_:
                            open_[1].close()
                        open_ = (name, BundleReader(folder, name))
                    data, at = open_[1].frame(frame), 0
                    for _ in range(n):
                        r, at = parse(data, at)
                        yield r
                    if at != len(data):
                        raise ValueError(f"frame {frame} of {name} holds more than its index says")
                if open_:
                    open_[1].close()
        yield from _records(found())
    return frames.mapInArrow(run, RECORD)


def fetch(wanted: DataFrame, path: str) -> DataFrame:
    """The records whose ids are in ``wanted.record_id``: one frame is unpacked per place wanted, and the record cut out by its offset."""
    folder = f"{path}/bundles"
    places = index(wanted.sparkSession, path).join(wanted.select("record_id").distinct(), "record_id", "left_semi").select(
        "bundle", "frame", "offset", "length").repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            bundle, data, now = None, b"", (None, None)
            for batch in batches:
                for name, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                    if now[0] != name:
                        if bundle:
                            bundle.close()
                        bundle = BundleReader(folder, name)
                    if now != (name, frame):
                        data, now = bundle.frame(frame), (name, frame)
                    r, end = parse(data, offset)
                    if end != offset + length:
                        raise ValueError(f"record at {offset} of frame {frame} is not {length} bytes long")
                    yield r
            if bundle:
                bundle.close()
        yield from _records(found())
    return places.mapInArrow(run, RECORD)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; a revisit's payload is that of the response it names."""
    rows = store(read(spark, path).drop("payload"))
    responses = rows.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("__page"), F.col("payload_bytes").alias("__bytes"),
        F.col("payload_digest").alias("__digest"))
    named = rows.where("refers_to_record is not null").groupBy("refers_to_record").agg(F.count(F.lit(1)).alias("n"))
    met = lookup_join(rows, store(responses.join(named, "refers_to_record")), "refers_to_record", "n")
    return met.select("page_id", F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"),
                      F.coalesce("payload_digest", "__digest").alias("payload_digest"), "record_type", F.col("__page").alias("refers_to"))
