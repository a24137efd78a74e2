"""WARC bundles: round trip, records by id, plain decoders, copies."""

import base64
import glob
import hashlib
import io

import pytest
import zstandard

from joinlift.llm import warc

SCHEMA = "page_id long, url string, html string, sha string, uid long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def plain(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of every row."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i), reverse=True)
    first, out = {}, []
    for i in order:
        page, _, html = rows[i]
        payload = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) >= least and payload in first:
            out.append((page, len(payload), sha, "revisit", first[payload]))
        else:
            first.setdefault(payload, page)
            out.append((page, len(payload), sha, "response", None))
    return sorted(out, key=str)


ROWS = ([(i, f"http://a{i}.com/ü\r\nX: y {i}", f"<html>{i} é \r\n\r\nWARC/1.1\r\n</html>" * (i % 5)) for i in range(120)]
        + [(200 + i, "http://copy.net/", "<p>copy</p>") for i in range(90)] + [(300, None, None), (301, "", ""), (None, "http://n/", "<p>n</p>")]
        + [(302, "u", "<p>n</p>"), (303, "http://z/", "z" * 300_000)] + [(400, "http://same/", "same")] * 7 + [(-5, "x", "same"), (None, "y", "only")])


@pytest.mark.parametrize("frame_bytes,bundle_bytes", [(1 << 20, 1 << 28), (2_000, 3_000), (1, 1)])
def test_round_trip(spark, tmp_path, frame_bytes, bundle_bytes):
    path = str(tmp_path / "w")
    warc.write(pages(spark, ROWS), path, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes)
    assert sorted((tuple(r) for r in warc.catalogue(spark, path).collect()), key=str) == plain(ROWS)
    records = warc.read(spark, path).collect()
    assert len({r["record_id"] for r in records}) == len(ROWS) == len(records)
    html = {bytes(r["payload"]) for r in records if r["payload"] is not None}
    assert html == {(h or "").encode() for _, _, h in ROWS}
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") == (r["refers_to_record"] is not None) for r in records)
    uris = {r["page_id"]: r["uri"] for r in records}
    assert uris[7] == "http://a7.com/ü%0D%0AX:%20y%207" and uris[300] is None and uris[301] is None


def test_records_by_id(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages(spark, ROWS), path, frame_bytes=2_000, bundle_bytes=3_000)
    all_ = {r["record_id"]: r for r in warc.read(spark, path).collect()}
    some = sorted(all_)[::7]
    wanted = spark.createDataFrame([(i,) for i in [*some, some[0], "urn:uuid:none"]], "record_id string")
    assert {r["record_id"]: r for r in warc.fetch(wanted, path).collect()} == {i: all_[i] for i in some}
    # an offset is relative to its own frame, and opens it alone
    place = warc.index(spark, path).where("offset > 0").first()
    bundle = warc.BundleReader(f"{path}/bundles", place["bundle"])
    found, end = warc.parse(bundle.frame(place["frame"]), place["offset"])
    assert (found["record_id"], end) == (place["record_id"], place["offset"] + place["length"])


def test_plain_decoders_read_bundles(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages(spark, ROWS).repartition(3), path, frame_bytes=5_000)
    names = glob.glob(f"{path}/bundles/*.warc.zst")
    assert len(names) == warc.index(spark, path).select("bundle").distinct().count() > 1
    n = 0
    for name in names:
        raw = open(name, "rb").read()
        data, at = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read(), 0
        while at < len(data):
            _, at = warc.parse(data, at)
            n += 1
    assert n == len(ROWS)


def test_least_payload_and_small_tables(spark, tmp_path):
    for i, (rows, least) in enumerate([(ROWS, 10), (ROWS, 10 ** 9), ([], 0), ([(None, None, None)] * 3, 0), ([(1, None, "")], 0)]):
        path = str(tmp_path / f"w{i}")
        warc.write(pages(spark, rows), path, least=least)
        assert sorted((tuple(r) for r in warc.catalogue(spark, path).collect()), key=str) == plain(rows, least)


def test_a_bundle_of_a_lost_attempt_is_not_read(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages(spark, ROWS), path)
    (tmp_path / "w" / "bundles" / "dead.warc.zst").write_bytes(b"half a frame")
    assert warc.catalogue(spark, path).count() == len(ROWS)


def test_damage_is_told(spark, tmp_path):
    with pytest.raises(ValueError):
        warc.parse(b"no record")
    good = warc.record({"payload": b"abc", "refers_to_record": None, "record_id": "urn:uuid:1", "url": "u", "page_id": 1}, "2020-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"abc", b"abd"))
