"""Readers of sections, structures, rasters, audits and factors."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.geo import utm_inverse, wkt_points
from ..operators import cleaning as K
from .features import feature_texts

PAGE = 100_000
#: Name of a folder's list of the shapefiles that belong to it.
PARTS = "_parts.json"
# Names of an inventory's columns, in the order in which they are looked for.
LATITUDES, LONGITUDES = ("LAT_016", "I13", "LATITUDE", "LAT"), ("LONG_017", "I14", "LONGITUDE", "LONG", "LON")
CLEARANCES = ("VERTICAL_CLEARANCE_47", "MINIMUM_VERTICAL_CLEARANCE", "CLR_V_UNDER", "VERT_CLR", "CLEARANCE")


def sections_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sections from CSV. Every column is read as text, so that route names keep their zeros; files are split by Spark."""
    return K.normalized(spark.read.option("header", True).option("inferSchema", False).csv(path))


def geojson_wkt(geometry):
    """WKT of a GeoJSON geometry as text; null for anything but lines with two points or more."""
    g = F.from_json(geometry, "type string, coordinates string")
    one = lambda c: F.from_json(c, "array<array<double>>")
    many = F.from_json(g["coordinates"], "array<array<array<double>>>")
    text = lambda pts: F.concat(F.lit("("), F.array_join(F.transform(pts, lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))), ", "), F.lit(")"))
    line = F.when((g["type"] == "LineString") & (F.size(one(g["coordinates"])) >= 2), F.concat(F.lit("LINESTRING "), text(one(g["coordinates"]))))
    return line.when((g["type"] == "MultiLineString") & (F.size(many) >= 1), F.concat(F.lit("MULTILINESTRING ("), F.array_join(F.transform(many, text), ", "), F.lit(")")))


def sections_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Sections of GeoJSON feature collections in a file or folder, which are cut by byte ranges; coordinates are taken as they stand."""
    texts = feature_texts(spark, path if "://" in path else f"file://{path}")
    features = texts.select(F.from_json("value", "geometry string, properties map<string,string>").alias("f"))
    names = [r[0] for r in features.select(F.explode(F.map_keys("f.properties"))).distinct().orderBy(F.col("col")).collect()]
    return K.normalized(features.select(geojson_wkt(F.col("f.geometry")).alias("WKT"), *[F.col("f.properties")[n].alias(n) for n in names if n.lower() not in K.GEOMETRY_NAMES]))


def sections_pages(spark: SparkSession, path: str) -> DataFrame:
    """Sections from JSON arrays of objects whose line is a GeoJSON object; the raw geometry is dropped."""
    names = spark.read.option("multiLine", True).json(path).columns
    rows = spark.read.option("multiLine", True).schema(", ".join(f"`{c}` string" for c in names)).json(path)
    shape = next(c for c in ("line", "geometry", "the_geom") if c in names)
    return K.normalized(rows.withColumn("WKT", geojson_wkt(F.col(shape))).drop(shape))


def structures(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """structure_id, lon, lat and vertical_clearance of structures from CSV or XML rows; rows without a position go.

    Of the names that a column may have, the first that the table has counts, also in rows where it is null.
    """
    if kind == "csv":
        raw = spark.read.option("header", True).csv(path)
        raw = raw.select(*[F.col(f"`{c}`").alias(c.upper()) for c in raw.columns])
    else:
        text = spark.read.option("wholetext", True).text(path).select(K.bare_ampersands(F.col("value")).alias("x"))
        rows = text.select(F.explode(F.regexp_extract_all("x", F.lit(r"(?s)<row\b[^>]*>(.*?)</row>"), 1)).alias("r"))
        names = [*LATITUDES, *LONGITUDES, *CLEARANCES]
        there = rows.agg(*[F.bool_or(F.col("r").rlike(f"(?i)<{n}[ />]")).alias(n) for n in names]).first()
        raw = rows.select("r", *[F.nullif(F.regexp_extract("r", f"(?is)<{n}>(.*?)</{n}>", 1), F.lit("")).alias(n) for n in names if there[n]])
    own = lambda names: next((F.trim(F.col(n)) for n in names if n in raw.columns), F.lit(None).cast("string"))
    lon, lat = K.decimal_degrees(own(LONGITUDES), True), K.decimal_degrees(own(LATITUDES), False)
    out = raw.select(lon.alias("lon"), lat.alias("lat"), own(CLEARANCES).alias("vertical_clearance")).where("lon is not null and lat is not null")
    return out.select(F.xxhash64("lon", "lat", "vertical_clearance").alias("structure_id"), "lon", "lat", "vertical_clearance")


def raster(spark: SparkSession, path: str) -> DataFrame:
    """Elevations as a table (tile, row, col, z); voids below -1000 are null."""
    return spark.read.parquet(path).withColumn("z", F.when(F.col("z") >= -1000, F.col("z")))


def audit_csv(spark: SparkSession, path: str, numbers: list[str], flags: list[str]) -> DataFrame:
    """Calibration audit: the named columns as numbers ('' is null) and as flags ('true', '1', 'yes')."""
    raw = spark.read.option("header", True).csv(path)
    kind = lambda c: F.col(c).try_cast("double") if c in numbers else F.lower(F.trim(c)).isin("true", "1", "yes") if c in flags else F.col(c)
    return raw.select(*[kind(c).alias(c) for c in raw.columns])


def factors_json(spark: SparkSession, path: str) -> DataFrame:
    """Smoothing factors as (state, mode, f_system, factor) from a JSON object of objects."""
    text = spark.read.option("wholetext", True).text(path)
    e = text.select(F.explode(F.from_json("value", "map<string,map<string,int>>")).alias("state", "m")).select("state", F.explode("m").alias("k", "factor"))
    fs = F.coalesce(F.nullif(F.regexp_extract("k", r"_FS(\d)$", 1), F.lit("")).cast("int"), F.lit(1))
    return e.select("state", F.substring("k", 1, 1).alias("mode"), fs.alias("f_system"), "factor")


class PagedSections(DataSource):
    """Format `paged_sections`: a service of rows by limit and offset, read by several tasks at once.

    Options: url, an http(s) address that takes $limit, $offset, $select and $where, or path, a folder of page files
    (page-<number>.json); columns, names of text columns; limit, rows of a page; readers, tasks that read every readers-th
    page until one is short (so the number of pages need not be known); state, facility (1 and 2 unless said otherwise)
    and fsystem, which go into $where, as do Spark's own equality and IN filters; select, whether the service is asked for
    the named columns alone; token.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_sections"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self.options["columns"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.where = dict(options), []
        for column, option, default in (("stateid", "state", ""), ("facility_type", "facility", "1,2"), ("f_system", "fsystem", "")):
            if values := [v.strip() for v in self.options.get(option, default).split(",") if v.strip()]:
                self.where.append((column, values))

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.where.append((f.attribute[0], [f.value]))
            elif isinstance(f, In) and len(f.attribute) == 1:
                self.where.append((f.attribute[0], list(f.value)))
            yield f  # Spark checks again

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(int(self.options.get("readers", 4)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        columns, k = self.options["columns"].split(","), partition.value
        limit = int(self.options.get("limit", PAGE))
        while True:
            rows = self._page(k, limit)
            for row in rows:
                yield tuple(None if row.get(c) is None else row[c] if isinstance(row[c], str) else json.dumps(row[c]) for c in columns)
            if not rows or ("url" in self.options and len(rows) < limit):
                return
            k += int(self.options.get("readers", 4))

    def _asked(self, k: int, limit: int) -> dict[str, str]:
        """Arguments of the request for a page."""
        quoted = lambda v: "'" + str(v).replace("'", "''") + "'"
        out = {"$limit": str(limit), "$offset": str(k * limit)}
        if self.where:
            out["$where"] = " AND ".join(f"{c} IN ({', '.join(map(quoted, vs))})" for c, vs in self.where)
        if self.options.get("select", "").lower() == "true":
            out["$select"] = self.options["columns"]
        return out

    def _page(self, k: int, limit: int) -> list[dict]:
        import time
        import urllib.error
        import urllib.parse
        import urllib.request

        for attempt in range(1, 7):
            try:
                if "path" in self.options:
                    from pyarrow import fs

                    store, base = fs.FileSystem.from_uri(self.options["path"])
                    if store.get_file_info(f"{base}/page-{k}.json").type == fs.FileType.NotFound:
                        return []
                    with store.open_input_stream(f"{base}/page-{k}.json", compression=None) as f:
                        return json.loads(f.read())
                request = urllib.request.Request(f"{self.options['url']}?{urllib.parse.urlencode(self._asked(k, limit))}", headers={"X-App-Token": self.options["token"]} if self.options.get("token") else {})
                with urllib.request.urlopen(request, timeout=120) as f:
                    return json.loads(f.read())
            except OSError as e:
                lasting = isinstance(e, urllib.error.HTTPError) and e.code not in (429, 500, 502, 503, 504)
                if attempt == 6 or lasting:
                    raise
                time.sleep(min(60, 2**attempt) * float(self.options.get("patience", 1)))
        return []


class Shapefile(DataSource):
    """Format `shapefile`: lines of a .shp file with the attributes of its .dbf, one row a record: WKT, attributes (map of text).

    Option path: the .shp file, as a URI; the .shx and .dbf lie beside it. Of a folder, the files that its list of parts names
    are read, or all .shp files if it has none. The index gives every record's place, so tasks read RECORDS each by byte
    ranges of their own. Records without a line of two points have a null WKT.
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return "WKT string, attributes map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return ShapeReader(self.options["path"])


class ShapeReader(DataSourceReader):
    RECORDS = 50_000

    def __init__(self, path: str):
        self.path = path

    def _parts(self) -> list[str]:
        from pyarrow import fs

        if self.path.endswith(".shp"):
            return [self.path]
        store, base = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{base}/{PARTS}").is_file:
            with store.open_input_stream(f"{base}/{PARTS}", compression=None) as f:
                names = json.loads(f.read())
        else:
            names = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(base)) if i.extension == "shp")
        return [f"{self.path.rstrip('/')}/{n}" for n in names]

    def _open(self, path: str, suffix: str):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        return store.open_input_file(base.removesuffix(".shp") + suffix)

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self._parts():
            with self._open(path, ".shx") as f:
                n = (f.size() - 100) // 8
            out += [InputPartition((path, i, min(n, i + self.RECORDS))) for i in range(0, n, self.RECORDS)]
        return out or [InputPartition(("", 0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, a, b = partition.value
        if a == b:
            return
        with self._open(path, ".shx") as f:
            places = struct.unpack(f">{2 * (b - a)}i", f.read_at(8 * (b - a), 100 + 8 * a))
        with self._open(path, ".dbf") as f:
            head, width = struct.unpack("<HH", f.read_at(4, 8))
            table = f.read_at(width * (b - a), head + width * a)
            names = f.read_at(head - 33, 32)
        fields = [(names[i : i + 11].split(b"\0")[0].decode("latin-1"), names[i + 16]) for i in range(0, len(names) - 31, 32)]
        with self._open(path, ".shp") as f:
            for k in range(b - a):
                row, at, values = table[k * width : (k + 1) * width], 1, {}
                for name, size in fields:
                    values[name] = row[at : at + size].decode("utf-8", "replace").strip() or None
                    at += size
                yield line_wkt(f.read_at(2 * places[2 * k + 1], 2 * places[2 * k] + 8)), values


def line_wkt(record: bytes) -> str | None:
    """WKT of a shape record's content, of kind PolyLine, PolyLineZ or PolyLineM; null for any other, and for parts of one point."""
    if len(record) < 44 or struct.unpack_from("<i", record)[0] not in (3, 13, 23):
        return None
    parts, points = struct.unpack_from("<ii", record, 36)
    starts = [*struct.unpack_from(f"<{parts}i", record, 44), points]
    xy = struct.unpack_from(f"<{2 * points}d", record, 44 + 4 * parts)
    lines = ["(" + ", ".join(f"{xy[2 * i]!r} {xy[2 * i + 1]!r}" for i in range(a, b)) + ")" for a, b in zip(starts, starts[1:], strict=False) if b - a >= 2]
    return None if not lines else f"LINESTRING {lines[0]}" if len(lines) == 1 else f"MULTILINESTRING ({', '.join(lines)})"


def sections_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Sections of a shapefile of lines, in degrees: coordinates of a UTM zone, as its .prj says, are projected back; any other projection is an error."""
    spark.dataSource.register(Shapefile)
    rows = spark.read.format("shapefile").option("path", path).load()
    names = [r[0] for r in rows.select(F.explode(F.map_keys("attributes"))).distinct().orderBy(F.col("col")).collect()]
    text = spark.read.option("wholetext", True).text(path.removesuffix(".shp") + ".prj").first()
    found = re.search(r"UTM[_ ]zone[_ ](\d+)([NS])", text.value if text else "", re.IGNORECASE)
    shape = F.col("WKT")
    if found:
        epsg = F.lit((32600 if found[2].upper() == "N" else 32700) + int(found[1]))

        def back(q):
            lon, lat = utm_inverse(q["x"], q["y"], epsg)
            return F.format_string("%.8f %.8f", lon, lat)

        lines = F.transform(wkt_points(F.col("WKT")), lambda part: F.concat(F.lit("("), F.array_join(F.transform(part, back), ", "), F.lit(")")))
        shape = F.when(F.size(lines) == 1, F.concat(F.lit("LINESTRING "), lines[0])).when(F.size(lines) > 1, F.concat(F.lit("MULTILINESTRING ("), F.array_join(lines, ", "), F.lit(")")))
    elif text and re.search(r"PROJ", text.value, re.IGNORECASE):
        raise ValueError(f"{path}: no way back to degrees from this projection")
    return K.normalized(rows.select(shape.alias("WKT"), *[F.col("attributes")[n].alias(n) for n in names if n.lower() not in K.GEOMETRY_NAMES]))
