"""Shapefiles as a sink: every task writes files of its own, and a list of those that belong to the result is written last."""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BooleanType, DateType, NumericType, StructType, TimestampType

from .readers import PARTS

#: Bytes of shapes of a file, about, after which a task begins the next one; characters of a text, the most that the format has.
A_FILE, TEXT = 256 << 20, 254
# Fixed values of the format.
FILE_CODE, VERSION, LINE, LINE_ZM, NO_SHAPE, NO_M = 9994, 1000, 3, 13, 0, -1e39
DEGREES = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


def parsed(wkt: str | None) -> list[list[tuple[float, ...]]]:
    """Parts of a line's WKT, of points of two to four numbers; none of any other text, nor parts of one point."""
    if not wkt or not wkt.lstrip().upper().startswith(("LINESTRING", "MULTILINESTRING")):
        return []
    inner = [p.split(")")[0] for p in wkt.split("(") if ")" in p]
    try:
        parts = [[tuple(map(float, q.split())) for q in p.split(",")] for p in inner]
    except ValueError:
        return []
    return [p for p in parts if len(p) > 1 and len({len(q) for q in p}) == 1 and len(p[0]) in (2, 3, 4)]


def shape(parts: list[list[tuple[float, ...]]], measured: bool) -> bytes:
    """A shape's content: a line with its box, starts of parts and points, and z and m of each if measured."""
    if not parts:
        return struct.pack("<i", NO_SHAPE)
    points = [q for p in parts for q in p]
    xs, ys = [q[0] for q in points], [q[1] for q in points]
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    out = struct.pack(f"<i4d2i{len(parts)}i", LINE_ZM if measured else LINE, min(xs), min(ys), max(xs), max(ys), len(parts), len(points), *starts)
    out += struct.pack(f"<{2 * len(points)}d", *[c for q in points for c in q[:2]])
    if measured:
        for k, none in ((2, 0.0), (3, NO_M)):
            values = [q[k] if len(q) > k else none for q in points]
            out += struct.pack(f"<2d{len(values)}d", min(values), max(values), *values)
    return out


def field_names(columns: list[str]) -> list[str]:
    """Names of ten bytes at most, none twice."""
    out: list[str] = []
    for c in columns:
        base = c.encode()[:10].decode("utf-8", "ignore")
        name, k = base, 1
        while name.lower() in {x.lower() for x in out}:
            name, k = f"{base[: 10 - len(str(k)) - 1]}_{k}", k + 1
        out.append(name)
    return out


def text_of(value) -> bytes:
    """A value as the table holds it: nothing for null, numbers as they are read back, at most TEXT bytes of whole characters."""
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return b""
    return str(value).encode()[:TEXT].decode("utf-8", "ignore").encode()


class Part:
    """One shapefile in the making: shapes and rows, until it is written."""

    def __init__(self, names: list[str], numeric: list[bool], measured: bool):
        self.names, self.numeric, self.measured = names, numeric, measured
        self.shapes: list[bytes] = []
        self.rows: list[list[bytes]] = []
        self.size, self.box = 0, [math.inf, math.inf, -math.inf, -math.inf]

    def add(self, wkt: str | None, values: list) -> None:
        parts = parsed(wkt)
        own = shape(parts, self.measured)
        for p in parts:
            for q in p:
                self.box = [min(self.box[0], q[0]), min(self.box[1], q[1]), max(self.box[2], q[0]), max(self.box[3], q[1])]
        self.shapes.append(own)
        self.rows.append([text_of(v) for v in values])
        self.size += len(own)

    def head(self, length: int) -> bytes:
        box = self.box if self.box[0] <= self.box[2] else [0.0] * 4
        return struct.pack(">i5ii", FILE_CODE, 0, 0, 0, 0, 0, length // 2) + struct.pack("<ii8d", VERSION, LINE_ZM if self.measured else LINE, *box, 0.0, 0.0, 0.0, 0.0)

    def files(self) -> Iterator[tuple[str, bytes]]:
        at, index, body = 100, [], []
        for k, s in enumerate(self.shapes):
            index.append(struct.pack(">2i", at // 2, len(s) // 2))
            body.append(struct.pack(">2i", k + 1, len(s) // 2) + s)
            at += 8 + len(s)
        yield ".shp", self.head(at) + b"".join(body)
        yield ".shx", self.head(100 + 8 * len(index)) + b"".join(index)
        wide = [max([1, *(len(r[i]) for r in self.rows)]) for i in range(len(self.names))]
        fields = b"".join(struct.pack("<11sc4xBB14x", n.encode(), b"N" if num else b"C", w, min(15, max(0, w - 2)) if num and any(b"." in r[i] for r in self.rows) else 0) for i, (n, num, w) in enumerate(zip(self.names, self.numeric, wide, strict=True)))
        rows = b"".join(b" " + b"".join(v.rjust(w) if num else v.ljust(w) for v, w, num in zip(r, wide, self.numeric, strict=True)) for r in self.rows)
        yield ".dbf", struct.pack("<4BIHH20x", 3, 125, 1, 1, len(self.rows), 32 + len(fields) + 1, 1 + sum(wide)) + fields + b"\r" + rows + b"\x1a"
        yield ".cpg", b"UTF-8"
        yield ".prj", DEGREES.encode()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ShapeWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.geometry, self.measured = options.get("geometry", "WKT"), options.get("measured", "false").lower() == "true"
        self.most = int(options.get("file_bytes", A_FILE))
        if self.geometry not in schema.names:
            raise ValueError(f"no column {self.geometry}")
        self.columns = [f.name for f in schema.fields if f.name != self.geometry]
        self.numeric = [isinstance(f.dataType, NumericType) for f in schema.fields if f.name != self.geometry]
        if any(not isinstance(f.dataType, (NumericType, BooleanType, DateType, TimestampType)) and f.dataType.typeName() != "string" for f in schema.fields):
            raise ValueError("a shapefile's attributes are texts and numbers")
        self.names = field_names(self.columns)

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        """Files of this attempt alone, under names that no other has; a task that is tried again leaves the first one's unnamed."""
        store, base = self._store()
        store.create_dir(base)
        done: list[str] = []
        part = Part(self.names, self.numeric, self.measured)

        def close() -> None:
            name = f"part-{uuid.uuid4().hex}"
            for suffix, data in part.files():
                with store.open_output_stream(f"{base}/{name}{suffix}") as f:
                    f.write(data)
            done.append(f"{name}.shp")

        for r in rows:
            part.add(r[self.geometry], [r[c] for c in self.columns])
            if part.size >= self.most:
                close()
                part = Part(self.names, self.numeric, self.measured)
        if part.shapes:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """The list of parts, which replaces the one before, or goes on from it."""
        store, base = self._store()
        store.create_dir(base)
        new, old = [n for m in messages if m for n in m.names], []
        if store.get_file_info(f"{base}/{PARTS}").is_file:
            with store.open_input_stream(f"{base}/{PARTS}", compression=None) as f:
                old = json.loads(f.read())
        with store.open_output_stream(f"{base}/{PARTS}") as f:
            f.write(json.dumps(new if self.overwrite else old + new).encode())
        self._remove(old if self.overwrite else [])

    def abort(self, messages: list[Written | None]) -> None:
        self._remove([n for m in messages if m for n in m.names])

    def _remove(self, names: list[str]) -> None:
        store, base = self._store()
        for n in names:
            for suffix in (".shp", ".shx", ".dbf", ".cpg", ".prj"):
                if store.get_file_info(f"{base}/{n.removesuffix('.shp')}{suffix}").is_file:
                    store.delete_file(f"{base}/{n.removesuffix('.shp')}{suffix}")


class ShapeSink(DataSource):
    """`df.write.format("roadgeo_shapes")`: options path (a folder's URI), geometry (the column of WKT), measured (whether z and m are kept), file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "roadgeo_shapes"

    def writer(self, schema: StructType, overwrite: bool) -> ShapeWriter:
        return ShapeWriter(dict(self.options), schema, overwrite)


def write(df: DataFrame, path: str, geometry: str = "WKT", measured: bool = False, mode: str = "overwrite", file_bytes: int = A_FILE) -> None:
    """Write lines in degrees as shapefiles, one or more of each task, with a list of those that belong to the result.

    Texts are cut to TEXT bytes and names to ten, as the format has it; texts that aren't lines are empty shapes.
    """
    df.sparkSession.dataSource.register(ShapeSink)
    df.write.format("roadgeo_shapes").mode(mode).option("geometry", geometry).option("measured", str(measured).lower()).option("file_bytes", file_bytes).save(path)
