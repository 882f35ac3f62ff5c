"""Tiled GeoTIFF rasters as a data source: only the tags and the blocks that are asked for are read, by byte ranges.

A row is a cell: tile, row, col, z. Filters on `tile` (equality, in) leave out files by their names; filters that bound row
and col leave out blocks by their place in the grid. Blocks may be stored as they are, deflated or by LZW, whole numbers or
floats, with or without horizontal differencing, in tiles or in strips.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "tile string, row int, col int, z double"
ARROW = pa.schema([("tile", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("z", pa.float64())])
#: Bytes of compressed blocks of a task, about.
A_TASK = 32 << 20
#: Fixed values of the TIFF format: tags, sizes of field types and their struct letters, compressions, sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_A_STRIP, STRIP_BYTES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT, NO_DATA = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339, 42113
KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
STORED, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
FORMATS = {1: "u", 2: "i", 3: "f"}


def unpacked_lzw(data: bytes) -> bytes:
    """LZW of TIFF: codes of 9 to 12 bits, high bits first, each width one code earlier than needed."""
    table: list[bytes] = [bytes([k]) for k in range(256)] + [b"", b""]
    out, before, width, at, total = [], b"", 9, 0, len(data) * 8
    held, have, i = 0, 0, 0
    while at + width <= total:
        while have < width:
            held = (held << 8 | data[i]) & 0xFFFFFFFF
            have, i = have + 8, i + 1
        code = held >> (have - width) & ((1 << width) - 1)
        have, at = have - width, at + width
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        if code == 257:
            break
        if not before:
            word = table[code]
        else:
            word = table[code] if code < len(table) else before + before[:1]
            table.append(before + word[:1])
        out.append(word)
        before = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


@dataclass(frozen=True)
class Layout:
    """A file's grid of blocks, as its first directory states it."""

    width: int
    height: int
    wide: int
    high: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    compression: int
    predictor: int
    kind: str
    void: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.wide)

    def place(self, block: int) -> tuple[int, int]:
        """First row and column of a block."""
        return block // self.across * self.high, block % self.across * self.wide

    def cells(self, block: int, data: bytes) -> np.ndarray:
        """Elevations of a block, without what lies beyond the raster's edges."""
        top, left = self.place(block)
        raw = data if self.compression == STORED else unpacked_lzw(data) if self.compression == LZW else zlib.decompress(data)
        kind = np.dtype(self.kind)
        rows = min(self.high, len(raw) // (kind.itemsize * self.wide))  # the last strip may be short
        if self.predictor == 3:  # differences of bytes, planes of equal weight after each other, high ones first
            planes = np.cumsum(np.frombuffer(raw, np.uint8, rows * self.wide * kind.itemsize).reshape(rows, -1), axis=1, dtype=np.uint8)
            z = np.ascontiguousarray(planes.reshape(rows, kind.itemsize, self.wide).transpose(0, 2, 1)).view(kind.newbyteorder(">"))[:, :, 0]
        else:
            z = np.frombuffer(raw, kind, rows * self.wide).reshape(rows, self.wide)
            if self.predictor == 2:
                z = np.cumsum(z, axis=1, dtype=kind)
        return z[: self.height - top, : self.width - left].astype(float)


def layout(f) -> Layout:
    """The layout of an open file; what this reader can't read is an error that says so."""
    head = f.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] not in (42, 43):
        raise ValueError("no TIFF file")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    count, step, inline = ("Q", 20, 8) if big else ("H", 12, 4)
    n = struct.unpack(order + count, f.read_at(struct.calcsize(count), at))[0]
    directory = f.read_at(n * step, at + struct.calcsize(count))
    tags = {}
    for k in range(n):
        entry = directory[k * step : (k + 1) * step]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        many = struct.unpack(order + ("Q" if big else "I"), entry[4 : 4 + inline])[0]
        if kind not in KINDS:
            continue
        size = many * struct.calcsize(KINDS[kind])
        value = entry[-inline:][:size] if size <= inline else f.read_at(size, struct.unpack(order + ("Q" if big else "I"), entry[-inline:])[0])
        tags[tag] = value if kind == 2 else struct.unpack(order + str(many) + KINDS[kind], value)
    one = lambda tag, other: tags[tag][0] if tag in tags else other
    if one(SAMPLES, 1) != 1 or one(COMPRESSION, 1) not in (STORED, LZW, DEFLATE, OLD_DEFLATE) or one(PREDICTOR, 1) not in (1, 2, 3) or one(FORMAT, 1) not in FORMATS or one(BITS, 8) % 8:
        raise ValueError("a raster of one band, stored, deflated or by LZW, is needed")
    tiled = TILE_OFFSETS in tags
    wide, high = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (one(WIDTH, 0), min(one(ROWS_A_STRIP, 1 << 31), one(HEIGHT, 0)))
    text = tags.get(NO_DATA)
    void = float(text.rstrip(b"\0 ")) if text and text.strip(b"\0 ") else None
    return Layout(one(WIDTH, 0), one(HEIGHT, 0), wide, high, tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES], one(COMPRESSION, 1), one(PREDICTOR, 1), f"{order}{FORMATS[one(FORMAT, 1)]}{one(BITS, 8) // 8}", void)


@dataclass
class Blocks(InputPartition):
    """Blocks of one file that a task reads."""

    path: str
    tile: str
    layout: Layout = field(repr=False)
    blocks: tuple[int, ...] = ()


class RasterReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.tiles: set[str] | None = None
        self.low, self.high = {"row": 0, "col": 0}, {"row": 1 << 31, "col": 1 << 31}

    def pushFilters(self, filters) -> Iterator:
        """Tiles and ranges of rows and columns are noted; rows are filtered by them again, as blocks reach beyond them."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "tile" and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tiles = asked if self.tiles is None else self.tiles & asked
            elif name in self.low and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Blocks]:
        """Tags of the asked files alone are read here; blocks that lie in the asked rows and columns go to tasks of A_TASK bytes."""
        store, base = fs.FileSystem.from_uri(self.path)
        out = []
        for info in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda i: i.path):
            tile, kind = os.path.splitext(info.base_name)
            if kind.lower() not in (".tif", ".tiff") or (self.tiles is not None and tile not in self.tiles):
                continue
            with store.open_input_file(info.path) as f:
                own = layout(f)
            asked, size = [], 0
            for k in range(len(own.offsets)):
                top, left = own.place(k)
                if top > self.high["row"] or left > self.high["col"] or top + own.high <= self.low["row"] or left + own.wide <= self.low["col"] or not own.sizes[k]:
                    continue
                asked.append(k)
                size += own.sizes[k]
                if size >= A_TASK:
                    out.append(Blocks(info.path, tile, own, tuple(asked)))
                    asked, size = [], 0
            if asked:
                out.append(Blocks(info.path, tile, own, tuple(asked)))
        return out or [Blocks("", "", Layout(0, 0, 1, 1, (), (), 1, 1, "<f4", None))]

    def read(self, p: Blocks) -> Iterator[pa.RecordBatch]:
        if not p.blocks:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(p.path) as f:
            for k in p.blocks:
                z = p.layout.cells(k, f.read_at(p.layout.sizes[k], p.layout.offsets[k]))
                top, left = p.layout.place(k)
                row, col = np.divmod(np.arange(z.size, dtype=np.int32), np.int32(max(z.shape[1], 1)))
                z = z.ravel()
                known = pa.array(z, mask=np.isnan(z) if p.layout.void is None else np.isnan(z) | (z == p.layout.void))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), p.tile, object), pa.string()), pa.array(row + np.int32(top)), pa.array(col + np.int32(left)), known], schema=ARROW)


class RasterSource(DataSource):
    """`spark.read.format("roadgeo_raster").load(folder)`: all .tif files of a folder, each a tile named by its file."""

    @classmethod
    def name(cls) -> str:
        return "roadgeo_raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(self.options["path"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of a folder of TIFF files, whose URI pyarrow's file systems know; filters are pushed into the source."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("roadgeo_raster").load(folder)


def around(spark: SparkSession, folder: str, points: DataFrame, lon: str, lat: str, tile_of, most: int = 10_000) -> DataFrame:
    """Cells of the tiles that points lie in: these tiles, `most` of them at most, are pushed into the source; of more, all files are read.

    tile_of gives the name of a point's tile. Points are read once, for the distinct tiles; they never shuffle with cells of other tiles.
    """
    cells = read(spark, folder)
    tiles = [r[0] for r in points.select(tile_of(F.col(lon), F.col(lat)).alias("t")).where("t is not null").distinct().limit(most + 1).collect()]
    return cells.where(F.col("tile").isin(tiles)) if len(tiles) <= most else cells
