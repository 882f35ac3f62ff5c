"""Rasters, feature collections, shapefiles, tables of states and table functions against what was written, by hand or by plain Python."""

from __future__ import annotations

import json
import random
import struct
import threading
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadgeo.config import Params
from roadgeo.functions import geo, tables
from roadgeo.kernels import profile, smooth
from roadgeo.operators import spatial
from roadgeo.sources import features, raster, readers, shapes, states


def packed_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: the width grows as entry 511, 1023 or 2047 is added; a clear code before the table is full."""
    codes, table, width, word = [(256, 9)], {bytes([k]): k for k in range(256)}, 9, b""
    size = 258
    for k in data:
        c = bytes([k])
        if word + c in table:
            word += c
            continue
        codes.append((table[word], width))
        table[word + c] = size
        size += 1
        if size in (512, 1024, 2048):
            width += 1
        if size == 4095:
            codes.append((256, width))
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        word = c
    if word:
        codes.append((table[word], width))
        if size + 1 in (512, 1024, 2048):
            width += 1
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def tiff(z: np.ndarray, block=(16, 32), compression=8, order="<", predictor=1, strips=False, void=None) -> bytes:
    """A file of one band with the values of z in its own type."""
    kind = z.dtype.newbyteorder(order)
    high, wide = (block[0], z.shape[1]) if strips else block
    blocks = []
    for r in range(0, z.shape[0], high):
        for c in range(0, z.shape[1], wide):
            own = np.zeros((min(high, z.shape[0] - r) if strips else high, wide), z.dtype)
            part = z[r : r + high, c : c + wide]
            own[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                own = np.concatenate((own[:, :1], np.diff(own, axis=1)), axis=1)
            raw = own.astype(kind).tobytes()
            if predictor == 3:
                planes = np.frombuffer(own.astype(z.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(len(own), wide, z.itemsize).transpose(0, 2, 1).reshape(len(own), -1)
                raw = np.concatenate((planes[:, :1], np.diff(planes, axis=1)), axis=1).tobytes()
            blocks.append({1: bytes, 5: packed_lzw, 8: zlib.compress}[compression](raw))
    offsets, at = [], 8
    for b in blocks:
        offsets.append(at)
        at += len(b)
    lists = struct.pack(f"{order}{2 * len(blocks)}I", *offsets, *map(len, blocks))
    text = str(void).encode() + b"\0" if void is not None else b""
    entry = lambda tag, kind, n, value: struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "I", value) if kind == 4 or n > 4 else struct.pack(order + "HH", value, 0))
    first, second = (273, 279) if strips else (324, 325)
    many = len(blocks)
    place = lambda k: (offsets[0], len(blocks[0]))[k] if many == 1 else at + 4 * many * k
    shape = [entry(278, 4, 1, high)] if strips else [entry(322, 4, 1, wide), entry(323, 4, 1, high)]
    formats = {"u": 1, "i": 2, "f": 3}
    tags = [entry(256, 4, 1, z.shape[1]), entry(257, 4, 1, z.shape[0]), entry(258, 3, 1, z.itemsize * 8), entry(259, 3, 1, compression), entry(277, 3, 1, 1), entry(317, 3, 1, predictor), entry(339, 3, 1, formats[z.dtype.kind]), *shape, entry(first, 4, many, place(0)), entry(second, 4, many, place(1))]
    if text:
        tags.append(struct.pack(order + "HHI", 42113, 2, len(text)) + struct.pack(order + "I", at + len(lists)))
    tags.sort(key=lambda t: struct.unpack(order + "H", t[:2])[0])
    directory = struct.pack(order + "H", len(tags)) + b"".join(tags) + b"\0" * 4
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at + len(lists) + len(text))
    return head + b"".join(blocks) + lists + text + directory


KINDS = [
    dict(compression=1), dict(compression=8), dict(compression=5), dict(compression=5, predictor=2, kind="i2", order=">"), dict(compression=8, predictor=2, kind="u2"), dict(compression=8, predictor=3), dict(compression=8, predictor=3, order=">", kind="f8"),
    dict(compression=8, strips=True, block=(7, 0)), dict(compression=1, order=">", kind="i4"), dict(compression=5, block=(128, 128), void=-9999),
]


@pytest.mark.parametrize("k", range(len(KINDS)))
def test_raster_blocks(spark, tmp_path, k):
    own = dict(KINDS[k])
    rng = np.random.default_rng(k)
    z = (np.cumsum(rng.normal(0, 30, (50, 75)), axis=1) + 1000).astype(own.pop("kind", "f4"))
    if own.get("void"):
        z[3, 4] = own["void"]
    (tmp_path / "n46w121.tif").write_bytes(tiff(z, **own))
    (tmp_path / "notes.txt").write_text("no raster")
    df = raster.read(spark, f"file://{tmp_path}")
    got = {(r.row, r.col): r.z for r in df.collect()}
    assert got == {(r, c): (None if own.get("void") == z[r, c] else float(z[r, c])) for r in range(50) for c in range(75)} and df.first().tile == "n46w121"
    some = df.where("row >= 20 and row < 30 and col = 40 and tile = 'n46w121'").collect()
    assert sorted((r.row, r.col, r.z) for r in some) == [(r, 40, float(z[r, 40])) for r in range(20, 30)]


def test_only_what_is_asked_for_is_read(spark, tmp_path):
    z = np.arange(64 * 64, dtype="f4").reshape(64, 64)
    good = tiff(z, (16, 16))
    (tmp_path / "n46w121.tif").write_bytes(good)
    (tmp_path / "n47w121.tif").write_bytes(b"II*\0 not read, or it would be an error")
    folder = f"file://{tmp_path}"
    reader = raster.RasterReader(folder)
    list(reader.pushFilters([raster.EqualTo(("tile",), "n46w121"), raster.GreaterThanOrEqual(("row",), 16), raster.LessThan(("row",), 32), raster.EqualTo(("col",), 63)]))
    assert [p.blocks for p in reader.partitions()] == [(7,)]  # one of sixteen blocks
    points = spark.createDataFrame([(1, -120.9999, 45.9999), (2, -120.99, 45.98), (3, None, 1.0)], "id int, lon double, lat double")
    cells = raster.around(spark, folder, points, "lon", "lat", geo.tile_name)
    got = {r.id: r.z for r in spatial.sampled(points, cells, "lon", "lat", "z").collect()}
    assert got == {1: 0.0, 2: float(z[48, 24]), 3: None}
    with pytest.raises(ValueError, match="one band"):
        (tmp_path / "x").mkdir()
        (tmp_path / "x/a.tif").write_bytes(good.replace(struct.pack("<HHIHH", 259, 3, 1, 8, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0)))
        raster.RasterReader(f"file://{tmp_path}/x").partitions()
    assert raster.read(spark, f"file://{tmp_path}").where("tile = 'n10w001'").count() == 0


def collection(n, seed, ascii_only):
    r = random.Random(seed)
    odd = ["plain", 'quo"te', "back\\slash", "\\\\\"", "{[", "]}", 'x","features":[{', "é漢🙂", "\n\t", "", "\\" * 9]
    made = [{"type": "Feature", "properties": {"route_id": f"r{k}", "note": "".join(r.choice(odd) for _ in range(r.randint(0, 6))), "deep": None}, "geometry": {"type": "LineString", "coordinates": [[k, 0.5], [k + 1, 1.5]]}} for k in range(n)]
    extra = {"type": "FeatureCollection", "name": 'a{"b', "crs": {"type": "name", "properties": {"name": "x", "list": [[{"type": "no"}]]}}, "others": [{"type": "Thing", "id": 1}, {"type": "Thing"}], "features": made, "after": [{"a": 1}]}
    return made, json.dumps(extra, ensure_ascii=ascii_only, indent=r.choice([None, 2]))


@pytest.mark.parametrize(("size", "ascii_only"), [(37, True), (61, False), (500, False), (1 << 20, True)])
def test_feature_collections_by_ranges(spark, tmp_path, size, ascii_only):
    made, text = collection(14, size, ascii_only)
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    (tmp_path / "c.json").write_text("")
    got = [json.loads(r.value) for r in features.feature_texts(spark, f"file://{tmp_path}", size).collect()]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, made))
    whole = spark.read.option("multiLine", True).schema("features array<struct<properties: map<string,string>>>").json(f"{tmp_path}/a.json").select(F.explode("features").alias("f")).select(F.col("f.properties")["note"])
    assert sorted(f["properties"]["note"] for f in got) == sorted(r[0] for r in whole.collect())
    assert {r.RouteId for r in readers.sections_geojson(spark, f"file://{tmp_path}/a.json").collect()} == {f"R{k}" for k in range(14)}


def test_sums_of_ranges_are_those_of_plain_reading():
    for seed in range(30):
        _, text = collection(4, seed, seed % 2 == 0)
        data = text.encode()
        r = random.Random(seed)
        for _ in range(30):
            k = r.randint(0, len(data))
            inside, stack, i = False, [], 0
            while i < k:
                c = data[i : i + 1]
                if inside:
                    i += c == b"\\"
                    inside = c != b'"'
                elif c == b'"':
                    inside = True
                elif c in b"{[":
                    stack.append(c.decode())
                elif c in b"]}":
                    stack.pop()
                i += 1
            if i == k:  # not within an escape
                assert features.summed(data[:k], False) == ("", "".join(stack), inside)
                closes, opens, _ = features.summed(data[k:], inside)
                assert (len(closes), opens) == (len(stack), "")


def test_shapefiles_are_read_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    line = lambda n: "(" + ", ".join(f"{float(x)!r} {float(y)!r}" for x, y in rng.uniform(-100, 100, (n, 2))) + ")"
    rows = [(f"r{k}", k, k / 8, None if k % 5 == 0 else "é" * 200, "LINESTRING " + line(3 + k % 4) if k % 3 else f"MULTILINESTRING ({line(2)}, {line(4)})") for k in range(60)]
    rows += [("bad", 1, None, "x", "POINT (1 2)"), ("none", None, 2.5, None, None)]
    df = spark.createDataFrame(rows, "RouteId string, a_very_long_name int, a_very_long_number double, text string, WKT string").repartition(3)
    path = f"file://{tmp_path}/out"
    shapes.write(df, path, file_bytes=2000)
    names = json.loads((tmp_path / "out/_parts.json").read_text())
    assert len(names) > 3
    (tmp_path / "out/part-left.shp").write_bytes(b"of a task that died")
    spark.dataSource.register(readers.Shapefile)
    got = {r.attributes["RouteId"]: r for r in spark.read.format("shapefile").option("path", path).load().collect()}
    assert len(got) == len(rows)
    for route, n, x, text, wkt in rows:
        r = got[route]
        assert r.WKT == (wkt if wkt and "LINE" in wkt else None)
        assert (r.attributes["a_very_lon"], r.attributes["a_very_l_1"], r.attributes["text"]) == (None if n is None else str(n), None if x is None else str(x), text and text[:127])
    shapes.write(df.where("RouteId = 'r1'"), path, mode="append")
    assert spark.read.format("shapefile").option("path", path).load().count() == len(rows) + 1
    shapes.write(df.where("RouteId = 'r1'"), path)
    assert spark.read.format("shapefile").option("path", path).load().count() == 1 and not (tmp_path / "out" / names[0]).exists()
    zm = spark.createDataFrame([("LINESTRING ZM (1 2 3 4, 5 6 7 8)",)], "WKT_ZM string")
    shapes.write(zm, f"file://{tmp_path}/zm", "WKT_ZM", True)
    name = json.loads((tmp_path / "zm/_parts.json").read_text())[0]
    content = (tmp_path / "zm" / name).read_bytes()[108:]
    assert struct.unpack_from("<i", content)[0] == 13 and struct.unpack_from("<4d2i1i4d4d4d", content, 4)[7:] == (1.0, 2.0, 5.0, 6.0, 3.0, 7.0, 3.0, 7.0, 4.0, 8.0, 4.0, 8.0)
    with pytest.raises(Exception, match="texts and numbers"):
        shapes.write(df.withColumn("x", F.array("text")), path)


def test_states_of_several_writers(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    rows = lambda state, n: spark.createDataFrame([(state, k, n) for k in range(3)], "state string, k int, n int")
    content = lambda: sorted((r.state, r.n) for r in states.read(spark, table).select("state", "n").distinct().collect())
    with pytest.raises(FileNotFoundError):
        states.read(spark, table)
    assert states.upsert(rows("A", 1).union(rows(None, 0)), table) == 1
    errors, wait = [], threading.Barrier(4)

    def write(state, n):
        try:
            df = rows(state, n)
            wait.wait()
            states.upsert(df, table)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=a) for a in (("B", 1), ("C", 1), ("D", 1), ("E", 1))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted((r.state or "", r.n) for r in states.read(spark, table).select("state", "n").distinct().collect()) == [("", 0), ("A", 1), ("B", 1), ("C", 1), ("D", 1), ("E", 1)]
    states.upsert(rows("A", 2), table)
    states.upsert(rows("A", 3), table)  # the later one of a state counts
    assert ("A", 3) in [(r.state, r.n) for r in states.read(spark, table).collect()] and states.read(spark, table).where("state = 'A'").count() == 3
    before = states.Folder(spark, table).latest()
    rows("B", 9).write.parquet(f"{table}/data-of-a-writer-that-died")
    assert states.Folder(spark, table).latest() == before and states.read(spark, table).where("n = 9").count() == 0
    assert states.read(spark, table, 1).where("state = 'A' and n = 1").count() == 3
    with pytest.raises(states.Conflict):
        states.Folder(spark, table).commit(before[0], {})
    assert states.Folder(spark, table).latest() == before
    states.vacuum(spark, table, 1)
    assert states.read(spark, table).where("state = 'A' and n = 3").count() == 3 and len(states.Folder(spark, table).numbers()) == 1
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) == len(set(before[1].values()))


def test_states_that_look_like_numbers(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    rows = lambda states, n: spark.createDataFrame([(s, n) for s in states], "state string, n int")
    states.upsert(rows(["01", "02"], 1), table)
    states.upsert(rows(["01", "AK"], 2), table)
    assert states.upsert(rows(["01"], 3).limit(0), table) == 2
    assert sorted((r.state, r.n) for r in states.read(spark, table).collect()) == [("01", 2), ("02", 1), ("AK", 2)]


def test_table_functions(spark):
    tables.register(spark)
    x = np.arange(600) * 3.0
    z = {"crest": 100 - (x - 900) ** 2 / 9000, "dip": np.where(abs(x - 900) < 30, 92.0, 100.0), "flat": np.full(600, 5.0)}
    rows = [(p, int(i), float(x[i]), None if p == "dip" and i == 5 else float(v[i])) for p, v in z.items() for i in np.random.default_rng(0).permutation(600)]
    spark.createDataFrame(rows, "path string, idx int, dist_m double, z double").repartition(5).createOrReplaceTempView("samples_of_paths")
    got = spark.sql("SELECT * FROM vertical_curves(TABLE(SELECT * FROM samples_of_paths WHERE path <> 'dip'))").collect()
    want = [(p, c["kind"], *(float(c[n]) for n in tables.VerticalCurves.NUMBERS)) for p in ("crest", "flat") for c in profile.vertical_curves(x, z[p], np.gradient(z[p], x) * 100, Params())]
    assert sorted(map(tuple, got)) == sorted(want) and any(r.kind == "CREST" for r in got)
    got = spark.sql("SELECT * FROM repaired_profile(TABLE(samples_of_paths), 3.0D) WHERE path = 'dip' ORDER BY idx").toPandas()
    ground = z["dip"].copy()
    ground[5] = np.nan
    ground, none = smooth.filled(ground), np.zeros(600, int)
    fixed, tier = profile.repair_dips(ground, profile.trend_of(ground, none, 3.0, Params()), none, 3.0, Params())
    assert np.allclose(got.z, fixed) and (got.tier == tier).all() and set(tier) == {0, 3} and isinstance(got, pd.DataFrame)
    with pytest.raises(Exception, match="no column dist_m"):
        spark.sql("SELECT * FROM vertical_curves(TABLE(SELECT path, idx, z FROM samples_of_paths))").collect()
