from __future__ import annotations

import hashlib
import zlib

import pytest
import zstandard
from pyarrow import fs

from roadgeo.llm import media, warc

TEXTS = [None, "", "a", "x" * 64, "é" * 40, "long " * 60_000, "a", "\x00" * 70]


def test_media_round_trip(spark, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE_BYTES", 500)
    docs = spark.createDataFrame([(i if i != 2 else None, t, b"z") for i, t in enumerate(TEXTS)], "doc_id long, text string, media binary").coalesce(2)
    rows = {r.doc_id: r for r in media.columns(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r, raw = rows[i if i != 2 else None], (t or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_sha256, r.media_bytes) == (hashlib.sha256(media.encode(p)).hexdigest(), len(media.encode(p))) and media.decode(media.encode(p)) == p
    assert rows[None].feature == rows[6].feature
    assert media.columns(docs.limit(0)).collect() == []


def test_members_are_tried_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "WAIT", 0.0)
    path = f"file://{tmp_path}/m"
    media.write(spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string").coalesce(1), path)
    reader = media.Reader({"path": path})
    (part,) = reader.partitions()
    want = [b.to_pydict() for b in reader.read(part)]
    assert len(want[0]["doc_id"]) == 9

    class Failing:
        def __init__(self, store):
            self.store, self.left = store, 3

        def open_input_file(self, name):
            self.left -= 1
            if self.left > 0:
                raise OSError("gone for now")
            return self.store.open_input_file(name)

    import zipfile

    store, base = fs.FileSystem.from_uri(path)
    info = zipfile.ZipFile(store.open_input_file(f"{base}/{part.archive}")).infolist()[4]
    assert media.Members(Failing(store), f"{base}/{part.archive}", 4).read(info) == want[0]["media"][4]
    with pytest.raises(OSError):
        media.Members(Failing(store), f"{base}/{part.archive}", 1).read(info)
    raw = bytearray((tmp_path / "m" / part.archive).read_bytes())
    raw[info.header_offset + 60] ^= 1
    (tmp_path / "m" / part.archive).write_bytes(raw)
    with pytest.raises(OSError):
        media.Members(store, f"{base}/{part.archive}", 2).read(info)


def test_ranges_hold_each_member_once(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/m"
    media.write(spark.createDataFrame([(i, f"text {i} " * i) for i in range(60)], "doc_id long, text string").repartition(3), path)
    monkeypatch.setattr(media, "RANGE_BYTES", 700)
    reader = media.Reader({"path": path})
    ids = [i for p in reader.partitions() for b in reader.read(p) for i in b.column("doc_id").to_pylist()]
    assert sorted(ids) == list(range(60)) and len(reader.partitions()) > 10


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 600)
    big, small = "p" * 100, "p" * 99
    rows = [(5, "http://a\r\nX: y", big), (3, "u", big), (9, "u", big), (4, None, small), (2, "u", small), (7, "u", None), (8, "u", "long é " * 50_000), (9, "u", big), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").coalesce(2)
    got = sorted(warc.archived(pages).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(2, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 3), (7, "response", None), (8, "response", None), (9, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3)]
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert warc.archived(pages.limit(0)).collect() == []


def test_bundles_are_plain_zstandard_with_a_seek_table(tmp_path):
    store, base = fs.FileSystem.from_uri(f"file://{tmp_path}")
    w = warc.BundleWriter(store.open_output_stream(f"{base}/b", compression=None))
    records = [bytes([65 + i]) * 100_000 for i in range(7)]
    places = [w.add(r) for r in records]
    w.close()
    r = warc.BundleReader(store.open_input_file(f"{base}/b"))
    for (frame, at), rec in zip(places, records, strict=True):
        assert r.frame(frame)[at : at + len(rec)] == rec
    with (tmp_path / "b").open("rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(records)


def test_every_revisit_names_a_record_that_is_there(spark, tmp_path):
    big = "q" * 150
    rows = [(i % 4, "u", big) for i in range(12)] + [(None, "u", big), (None, "u", "r" * 200), (None, "u", "r" * 200), (50, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    index = warc.write(pages, f"file://{tmp_path}/w")
    records = warc.read(index, f"file://{tmp_path}/w").collect()
    ids = {r.record_id for r in records}
    assert len(ids) == len(records) == len(rows)
    kinds = {r.record_id: r.record_type for r in records}
    assert all(kinds[r.refers] == "response" for r in records if r.record_type == "revisit")
    got = warc.resolved(spark.createDataFrame(records)).collect()
    want = [("0", "response", None)] * 3 + [(str(i), "revisit", 0) for i in (1, 2, 3)] * 3 + [("None", "revisit", 0)] + [("None", "response", None)] * 2 + [("50", "response", None)]
    assert sorted(map(str, ((str(r.page_id), r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    lost = spark.createDataFrame([r for r in records if not (r.record_type == "response" and r.page_id == 0)])
    with pytest.raises(Exception, match="no such payload"):
        warc.resolved(lost).collect()
