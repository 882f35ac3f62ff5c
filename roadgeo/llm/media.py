"""Media columns: payloads as lossless 8-bit images in archives, read back by a data source that plans byte ranges."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import as_bytes, as_long, as_text, batch, limit_batches, own_dir

#: Width of the images: payloads are multiples of it. Bytes of an archive before the next begins, of a reader's range, of a streamed batch.
ROW, ARCHIVE_BYTES, RANGE_BYTES, STREAM_BYTES = 64, 64 << 20, 8 << 20, 4 << 20
#: Times that a member is read before the task fails, and seconds to wait before the next time.
TRIES, WAIT = 4, 0.2
_PNG = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """The data with bytes 0 up to a positive multiple of ROW."""
    return data + bytes(max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def encode(payload: bytes) -> bytes:
    """PNG, grey, 8 bits a sample, ROW samples wide; equal payloads give equal bytes."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    chunks = (b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes(), 3)), (b"IEND", b"")
    return _PNG + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)


def decode(media: bytes) -> bytes:
    """The samples of an image that encode() made; ValueError if it is damaged."""
    if media[:8] != _PNG:
        raise ValueError("not an image")
    at, data, shape = 8, b"", (0, 0)
    while at + 12 <= len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a filter that encode() doesn't use")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation, entropy, share of changes along rows and down columns, and eight shares of grey levels."""
    x = np.frombuffer(payload, np.uint8)
    c = np.bincount(x, minlength=256)
    p = c[c > 0] / len(x)
    mean = float((c * np.arange(256)).sum() / len(x))
    dev = float(np.sqrt(max(0.0, (c * np.arange(256.0) ** 2).sum() / len(x) - mean**2)))
    along, down = float((x[1:] != x[:-1]).mean()), float((x[ROW:] != x[:-ROW]).mean()) if len(x) > ROW else 0.0
    shares = c.reshape(8, 32).sum(axis=1) / len(x)
    return ",".join(f"{v:.4f}" for v in (mean, dev, float(-(p * np.log2(p)).sum()), along, down, *shares))


@dataclass
class Range(InputPartition):
    """The members of an archive whose headers begin in [start, end)."""

    archive: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list


class MediaArchives(DataSource):
    """Format `media_archive`: a folder of ZIP archives with stored members and a list of those committed.

    Rows written are (doc_id long, text string); rows read (doc_id long, n_bytes long, archive string, at long, media
    binary). The folder is a URI that pyarrow's file systems open (file, hdfs, s3, gs).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, archive string, at long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options)


class Writer(DataSourceArrowWriter):
    """Every attempt of a task writes archives of its own names; only those of the attempts that Spark commits are listed."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        made, archive, out, n = [], None, None, 0
        for b in iterator:
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                if archive is None:
                    name = f"part-{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    archive = zipfile.ZipFile(_Counted(out), "w", zipfile.ZIP_STORED)
                archive.writestr(f"{n:08d}_{'null' if doc is None else doc}_{len(text)}.png", encode(padded(text)))
                n += 1
                if archive.fp.tell() >= ARCHIVE_BYTES:
                    made.append(self._close(archive, out, name))
                    archive = None
        if archive is not None:
            made.append(self._close(archive, out, name))
        return Written(made)

    @staticmethod
    def _close(archive, out, name) -> tuple[str, int]:
        target = archive.fp
        archive.close()
        size = target.tell()
        out.close()
        return name, size

    def commit(self, messages) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/_committed.json") as f:
            f.write(json.dumps(sorted(a for m in messages if m for a in m.archives)).encode())

    def abort(self, messages) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _ in m.archives if m else ():
                store.delete_file(f"{base}/{name}")


class _Counted(io.RawIOBase):
    """A write-only stream that knows its place, as zipfile wants."""

    def __init__(self, out):
        super().__init__()
        self.out, self.n = out, 0

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.n += len(data)
        return len(data)

    def tell(self) -> int:
        return self.n

    def flush(self) -> None:
        pass

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.tries = int(options.get("tries", TRIES))

    def partitions(self) -> list[InputPartition]:
        """Byte ranges over the committed archives, from their names and sizes alone."""
        store, base = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{base}/_committed.json") as f:
            archives = json.loads(f.read())
        return [Range(name, i, min(i + RANGE_BYTES, size)) for name, size in archives for i in range(0, size, RANGE_BYTES)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """The range's members in Arrow batches of STREAM_BYTES or so; each is read by its offset and tried again alone."""
        if not part.archive:
            return
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("archive", pa.string()), ("at", pa.int64()), ("media", pa.binary())])
        store, base = fs.FileSystem.from_uri(self.path)
        path = f"{base}/{part.archive}"
        source = Members(store, path, self.tries)
        members = [m for m in source.directory() if part.start <= m.header_offset < part.end]
        rows: list[tuple] = []
        size = 0
        for m in members:
            data = source.read(m)
            _, doc, n = m.filename.removesuffix(".png").split("_")
            rows.append((None if doc == "null" else int(doc), int(n), part.archive, m.header_offset, data))
            size += len(data)
            if size >= STREAM_BYTES:
                yield batch(schema, *zip(*rows, strict=True))
                rows, size = [], 0
        if rows:
            yield batch(schema, *zip(*rows, strict=True))


class Members:
    """Reads an archive's directory, and its members by offset; what fails, a read or a checksum, opens the file anew and is tried again alone."""

    def __init__(self, store, path: str, tries: int):
        self.store, self.path, self.tries, self.file = store, path, tries, None

    def _tried(self, read):
        for k in range(self.tries):
            try:
                if self.file is None:
                    self.file = self.store.open_input_file(self.path)
                return read(self.file)
            except (OSError, struct.error, zipfile.BadZipFile):
                self.file = None
                if k + 1 == self.tries:
                    raise
                time.sleep(WAIT * 2**k)
        raise AssertionError

    def directory(self) -> list[zipfile.ZipInfo]:
        return self._tried(lambda f: zipfile.ZipFile(f).infolist())

    def read(self, m: zipfile.ZipInfo) -> bytes:
        def member(f) -> bytes:
            head = f.read_at(30, m.header_offset)
            names, extra = struct.unpack("<HH", head[26:30])
            data = f.read_at(m.file_size, m.header_offset + 30 + names + extra)
            if head[:4] != b"PK\x03\x04" or zlib.crc32(data) != m.CRC:
                raise OSError(f"{self.path} at {m.header_offset}: damaged")
            return data

        return self._tried(member)


def write(docs: DataFrame, path: str) -> None:
    """Archive every row's text; null is empty. No shuffle: each task writes archives of its own."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchives)
    limit_batches(spark)
    docs.select(as_long(docs, "doc_id").alias("doc_id"), as_text(docs).alias("text")).write.format("media_archive").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The members of an archive folder."""
    spark.dataSource.register(MediaArchives)
    limit_batches(spark)
    return spark.read.format("media_archive").option("path", path).load()


def columns(docs: DataFrame) -> DataFrame:
    """A digest of every row's payload as it was stored and read back; rows are as many as those of docs, ids may repeat.

    An empty table gives no rows; an empty or null text a payload of ROW zeros.
    """
    path = own_dir(docs.sparkSession, "media")
    write(docs, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for media in b.column("media").to_pylist():
                p = decode(media)
                out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(p)))
            if out:
                yield batch(schema, b.column("doc_id"), b.column("n_bytes"), *zip(*out, strict=True))

    return read(docs.sparkSession, path).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
