"""WARC archives in seekable Zstandard bundles, with an index of record identifiers to frame-relative offsets."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch, limit_batches, materialize, met, own_dir

#: Uncompressed bytes of a frame before the next begins, frames of a bundle, least payload that a revisit may stand for.
FRAME_BYTES, BUNDLE_FRAMES, LEAST_REVISIT = 256 << 10, 256, 100
#: Fixed values of the seekable format: the skippable frame's magic, the footer's magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "bundle string, frame int, at int, length int, record_id string"


class BundleWriter:
    """Groups records into independent frames; close() appends the seek table as a skippable frame."""

    def __init__(self, out, level: int = 3):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.size, self.frames = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset within the frame, uncompressed, at which the record will lie."""
        if self.size and self.size + len(record) > FRAME_BYTES:
            self._flush()
        at = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        return at

    def _flush(self) -> None:
        data = b"".join(self.held)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data)))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, file):
        self.file, size = file, file.size()
        count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        table = file.read_at(count * width, size - 9 - count * width)
        self.places, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.places.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.places[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


def record(kind: str, rid: str, url: str, payload: bytes, length: int, digest: str, refers: str | None) -> bytes:
    """A WARC/1.1 record; a revisit has no block, and gives its payload's length besides the digest."""
    block = payload if kind == "response" else b""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {length}"]
    if refers is not None:
        head += [f"WARC-Refers-To: <{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def hashed(pages: DataFrame) -> DataFrame:
    """page_id, url (null is empty), html (bytes, null is empty), digest and length of each row."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.coalesce(F.col("url").cast("string"), F.lit("")) if "url" in pages.columns else F.lit("")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(url, r"[\r\n]", " ").alias("url"), html.alias("html"))
    return rows.withColumns({"digest": F.sha2("html", 256), "length": F.length("html").cast("long")})


def bundled(rows: DataFrame, path: str) -> DataFrame:
    """Write bundles of rows (page_id, url, html, digest, length, refers, led) below the folder, as each task has them; returns an index row for each record.

    A row that refers to a record is a revisit. Record identifiers hold the page, the bundle and the number in it, so none
    occurs twice. Each attempt of a task writes bundles of its own names, and the index, kept in the shared folder, names
    only those of the attempts that Spark took; others stay unread.
    """
    schema = pa.schema([("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int32()), ("length", pa.int32()), ("record_id", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("led", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        out, name, index, n = None, "", [], 0
        for b in batches:
            for page, url, digest, size, refers, led, payload in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "digest", "length", "refers", "led")), as_bytes(b.column("html")), strict=True):
                if out is None:
                    name, n = uuid.uuid4().hex, 0
                    out = BundleWriter(store.open_output_stream(f"{base}/{name}.warc.zst", compression=None))
                rid = f"urn:page:{page}:{name}:{n}"
                data = record("response" if refers is None else "revisit", rid, url, payload, size, digest, refers)
                frame, at = out.add(data)
                index.append((f"{name}.warc.zst", frame, at, len(data), rid, page, digest, led))
                n += 1
                if len(out.frames) >= BUNDLE_FRAMES:
                    out.close()
                    out = None
            if index:
                yield batch(schema, *zip(*index, strict=True))
                index = []
        if out is not None:
            out.close()

    limit_batches(rows.sparkSession)
    return materialize(rows.select("page_id", "url", "html", "digest", "length", "refers", "led").mapInArrow(run, INDEX + ", page_id long, digest string, led boolean"))


def write(pages: DataFrame, path: str) -> DataFrame:
    """Write every page below the folder; returns the index, one row a record.

    Of pages with an equal payload of LEAST_REVISIT bytes or more, those with the smallest page_id (all rows that share it)
    are written first, as responses, with all pages that aren't repeated; the others follow as revisits of the first of
    these records, without their payloads. Which digests repeat is found with partial aggregates.
    """
    rows = hashed(pages)
    many = rows.where(F.col("length") >= LEAST_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    many = materialize(many)  # the repeated digests: a row each
    # A page may be repeated by a third of all rows: such digests are told to all tasks, and their pages are never one task's.
    first = met(rows, many, ["digest"], "n", ["page_id", "url"], "left").where("first is null or page_id <=> first")
    index = bundled(first.withColumns({"refers": F.lit(None).cast("string"), "led": F.col("first").isNotNull()}), path)
    leaders = index.where("led").groupBy("digest").agg(F.min("record_id").alias("refers"), F.min("page_id").alias("first"))
    leaders = materialize(leaders.join(many.select("digest", "n"), "digest"))
    others = met(rows.drop("html"), leaders, ["digest"], "n", ["page_id", "url"]).where("not page_id <=> first").withColumns({"html": F.lit(None).cast("binary"), "led": F.lit(False)})
    return index.unionByName(bundled(others, path)).select("bundle", "frame", "at", "length", "record_id")


def read(index: DataFrame, path: str) -> DataFrame:
    """The records that rows of an index name, by seek table and frame-relative offset; a frame is decompressed once.

    Rows are dealt by bundle and a hash of the frame, so that one bundle's frames spread over tasks.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string()), ("record_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        now, held, bundle = None, b"", None
        for b in batches:
            out = []
            for name, k, at, length, rid in zip(*(b.column(c).to_pylist() for c in ("bundle", "frame", "at", "length", "record_id")), strict=True):
                if now != (name, k):
                    if now is None or now[0] != name:
                        bundle = BundleReader(store.open_input_file(f"{base}/{name}"))
                    now, held = (name, k), bundle.frame(k)
                head, block = parsed(held[at : at + length])
                if head["WARC-Record-ID"] != f"<{rid}>":
                    raise ValueError(f"{name}, frame {k}: {rid} isn't at {at}")
                page = rid.split(":")[2]
                full = head["WARC-Type"] == "response"
                refers = None if full else head["WARC-Refers-To"].strip("<>")
                digest = hashlib.sha256(block).hexdigest() if full else head["WARC-Payload-Digest"].removeprefix("sha256:")
                out.append((None if page == "None" else int(page), len(block) if full else int(head["WARC-Payload-Length"]), digest, head["WARC-Type"], refers, rid))
            if out:
                yield batch(schema, *zip(*out, strict=True))

    limit_batches(index.sparkSession)
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(n, "bundle", F.floor(F.col("frame") / 16)).sortWithinPartitions("bundle", "frame", "at")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers string, record_id string")


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the response's page_id) of records read back.

    Each revisit is held against the record that it names: that this is there, is a response, and has the length and the
    digest that the revisit states, of the payload as read; else reading fails.
    """
    known = records.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    again = records.where("record_type = 'revisit'").join(known, "refers", "left")
    same = F.col("payload_digest").eqNullSafe(F.col("d")) & F.col("payload_bytes").eqNullSafe(F.col("b"))
    held = again.withColumn("refers_to", F.when(same, F.col("refers_to")).otherwise(F.raise_error(F.concat(F.lit("no such payload: "), "record_id", F.lit(" refers to "), "refers")).cast("long")))
    return records.where("record_type = 'response'").select(*out, F.lit(None).cast("long").alias("refers_to")).unionByName(held.select(*out, "refers_to"))


def archived(pages: DataFrame) -> DataFrame:
    """Write every page as a record, read all of them back by the index, and give a digest of each.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, those with the smallest page_id are responses (all rows
    that share it), the others revisits of it; a null page_id comes after all others, and pages without any page_id are
    all responses. Null html is empty; repeated rows are a record each; an empty table gives none.
    """
    path = own_dir(pages.sparkSession, "warc")
    return resolved(materialize(read(write(pages, path), path)))
