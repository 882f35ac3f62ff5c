"""Readers, sinks, plans and the feed on small files."""

from __future__ import annotations

import http.server
import json
import struct
import threading
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadgeo.config import Params
from roadgeo.functions import geo
from roadgeo.operators import cleaning, curves, intervals, spatial
from roadgeo.sources import readers, sinks
from roadgeo.streaming import sections as feed


def test_csv_keeps_zeros(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('route_id,bmp,emp,func_sys,line,WKT,extra\n 001 ,0.0,1.5,x,junk,"LINESTRING (0 0, 1 1)",e\n002,1,2,3,junk,,f\n')
    r = readers.sections_csv(spark, str(p)).collect()
    assert len(r) == 1 and r[0].RouteId == "001" and r[0].FSystem == 1 and r[0].WKT.startswith("LINESTRING") and r[0].extra == "e" and r[0].Facility_Type == 2
    with pytest.raises(ValueError):
        cleaning.normalized(spark.createDataFrame([(1,)], "a int"))


def test_geojson_and_pages(spark, tmp_path):
    feature = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 2]]}, "properties": {"route_id": "a", "begin": "0", "end": "1"}}
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, {**feature, "geometry": {"type": "Point", "coordinates": [0, 0]}}]}))
    r = readers.sections_geojson(spark, str(tmp_path / "g.json")).collect()
    assert len(r) == 1 and r[0].WKT == "LINESTRING (0.0 0.0, 1.0 2.0)" and r[0].RouteId == "A"
    rows = [{"route_id": "7", "begin_point": 0, "end_point": 1, "line": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}}]
    (tmp_path / "page-0.json").write_text(json.dumps(rows))
    got = readers.sections_pages(spark, str(tmp_path / "page-0.json")).collect()
    assert got[0].WKT == "MULTILINESTRING ((0.0 0.0, 1.0 1.0), (2.0 2.0, 3.0 3.0))"
    (tmp_path / "page-1.json").write_text(json.dumps([{"route_id": "8", "begin_point": 1}]))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(readers.PagedSections)
    paged = spark.read.format("paged_sections").option("path", f"file://{tmp_path}").option("columns", "route_id,begin_point,line").load()
    assert sorted(x.route_id for x in paged.collect()) == ["7", "8"]
    assert paged.where("route_id = '8'").count() == 1


def test_structures(spark, tmp_path):
    (tmp_path / "s.csv").write_text("LAT_016,LONG_017,VERTICAL_CLEARANCE_47\n47123456,122304050,0435\n0,0,1\n45.5,-120.25,14\n")
    r = sorted(readers.structures(spark, str(tmp_path / "s.csv")).collect())
    assert len(r) == 2 and r[1].lon == -120.25 and r[0].lat == pytest.approx(47 + 12 / 60 + 34.56 / 3600)
    (tmp_path / "t.xml").write_text("<rows><row><I13>45.5</I13><I14>-120</I14><CLR_V_UNDER>14 & up</CLR_V_UNDER></row><row><I13>0</I13></row><row><I13>46</I13><I14>-121</I14><CLEARANCE>9</CLEARANCE></row></rows>")
    x = readers.structures(spark, str(tmp_path / "t.xml"), "xml").collect()
    assert sorted((r.lon, r.vertical_clearance) for r in x) == [(-121.0, None), (-120.0, "14 &amp; up")]  # the first column there counts, null or not


def test_a_paged_service(spark):
    """A stub of the service on this machine: pages by limit and offset, a filter and a choice of columns in the request, and a page that fails once."""
    rows, asked, failed = [{"route_id": str(i), "facility_type": "1", "line": {"type": "Point"}} for i in range(25)], [], set()

    class Stub(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            asked.append((q, self.headers.get("X-App-Token")))
            if q["$offset"] == "10" and "10" not in failed:
                failed.add("10")
                return self.send_error(503)
            if "bad" in q["$where"]:
                return self.send_error(400)
            body = json.dumps(rows[int(q["$offset"]) : int(q["$offset"]) + int(q["$limit"])]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)
            return None

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
        spark.dataSource.register(readers.PagedSections)
        read = spark.read.format("paged_sections").options(url=f"http://127.0.0.1:{server.server_port}/x", columns="route_id,line", limit=10, readers=2, state="53", select="true", token="t", patience=0.01)
        got = read.load().collect()
        assert sorted(int(r.route_id) for r in got) == list(range(25)) and got[0].line == '{"type": "Point"}' and failed == {"10"}
        q, token = asked[0]
        assert token == "t" and q["$select"] == "route_id,line" and q["$where"] == "stateid IN ('53') AND facility_type IN ('1', '2')"
        assert read.load().where("route_id = '7'").count() == 1 and any("route_id IN ('7')" in q["$where"] for q, _ in asked)
        with pytest.raises(Exception, match="400"):
            read.option("state", "bad").load().collect()
    finally:
        server.shutdown()


def shapefile(folder, lines, rows, prj):
    """A shapefile of lines with text attributes, as other programs write it."""
    records = []
    for parts in lines:
        points = [p for part in parts for p in part]
        starts = [sum(len(q) for q in parts[:i]) for i in range(len(parts))]
        records.append(struct.pack("<i4d2i", 3, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + struct.pack(f"<{2 * len(points)}d", *[c for p in points for c in p]) if parts else struct.pack("<i", 0))
    shp, shx, at = b"", b"", 50
    for k, r in enumerate(records):
        shp += struct.pack(">ii", k + 1, len(r) // 2) + r
        shx += struct.pack(">ii", at, len(r) // 2)
        at += 4 + len(r) // 2
    (folder / "s.shp").write_bytes(b"\0" * 100 + shp)
    (folder / "s.shx").write_bytes(b"\0" * 100 + shx)
    names = list(rows[0])
    head = struct.pack("<4xIHH20x", len(rows), 33 + 32 * len(names), 1 + 10 * len(names)) + b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15 for n in names) + b"\r"
    (folder / "s.dbf").write_bytes(head + b"".join(b" " + b"".join(str(r[n]).encode().ljust(10) for n in names) for r in rows))
    (folder / "s.prj").write_text(prj)


def test_shapefiles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers.ShapeReader, "RECORDS", 2)
    rows = [{"ROUTE_ID": f"r{i}", "BMP": i, "EMP": i + 1} for i in range(5)]
    degrees = [[[(-120.4, 45.2), (-120.3, 45.25)]], [[(1.0, 2.0), (3.0, 4.0)], [(5.0, 6.0), (7.0, 8.0)]], [], [[(0.0, 0.0)]], [[(9.0, 9.0), (10.0, 10.0)]]]
    shapefile(tmp_path, degrees, rows, 'GEOGCS["WGS 84"]')
    got = {r.RouteId: (r.Start_MP, r.WKT) for r in readers.sections_shapefile(spark, f"file://{tmp_path}/s.shp").collect()}
    assert got == {"R0": (0.0, "LINESTRING (-120.4 45.2, -120.3 45.25)"), "R1": (1.0, "MULTILINESTRING ((1.0 2.0, 3.0 4.0), (5.0 6.0, 7.0 8.0))"), "R4": (4.0, "LINESTRING (9.0 9.0, 10.0 10.0)")}
    (tmp_path / "u").mkdir()
    e, n = (spark.range(1).select(c).first()[0] for c in geo.utm(F.lit(-120.4), F.lit(45.2), F.lit(32610)))
    shapefile(tmp_path / "u", [[[(e, n), (e + 100, n)]]], rows[:1], 'PROJCS["WGS 84 / UTM zone 10N"]')
    line = readers.sections_shapefile(spark, f"file://{tmp_path}/u/s.shp").first().WKT
    assert line.startswith("LINESTRING (-120.40000000 45.20000000")
    shapefile(tmp_path / "u", [[[(e, n), (e + 100, n)]]], rows[:1], 'PROJCS["Lambert"]')
    with pytest.raises(ValueError, match="degrees"):
        readers.sections_shapefile(spark, f"file://{tmp_path}/u/s.shp")


def test_factors_and_audit(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"01": {"H_SMOOTH_FACTOR": 400, "V_SMOOTH_FACTOR_FS3": 700}}))
    assert {tuple(r) for r in readers.factors_json(spark, str(tmp_path / "f.json")).collect()} == {("01", "H", 1, 400), ("01", "V", 3, 700)}
    (tmp_path / "a.csv").write_text("state,n,ok\n01,,Yes\n02,3,no\n")
    assert [tuple(r) for r in readers.audit_csv(spark, str(tmp_path / "a.csv"), ["n"], ["ok"]).orderBy("state").collect()] == [("01", None, True), ("02", 3.0, False)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("01", 1), ("02", 2)], "state string, n int")
    sinks.write_table(df, str(tmp_path / "t"))
    sinks.write_table(spark.createDataFrame([("02", 9)], "state string, n int"), str(tmp_path / "t"), mode="replace")
    assert {r.n for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {1, 9}
    pts = spark.createDataFrame([("r", [(0.0, 1.0), (2.0, 3.0)])], "route string, p array<struct<x:double,y:double>>")
    sinks.write_features(pts, "p", ["route"], str(tmp_path / "g"))
    f = json.loads(spark.read.text(str(tmp_path / "g")).first().value)
    assert f["geometry"]["coordinates"] == [[0.0, 1.0], [2.0, 3.0]] and f["properties"] == {"route": "r"}
    sinks.write_collection(pts.union(pts).coalesce(1), "p", ["route"], str(tmp_path / "fc"))
    c = json.loads(spark.read.text(str(tmp_path / "fc")).first().value)
    assert c["type"] == "FeatureCollection" and [x["properties"] for x in c["features"]] == [{"route": "r"}] * 2
    assert sinks.next_version(["a_v1.csv", "a_v12.csv", "b_v20.csv"], "a") == "a_v13"
    assert sinks.enriched_columns(spark.createDataFrame([("1", "x", "y")], "RouteId string, h_CURVE_bin string, keep string"), ["keep"]).columns == ["RouteId", "keep"]


def test_circle_and_line(spark):
    a = np.arange(0, 61) / 200 * 3.2
    arc = [("c", i, float(200 * np.sin(t)), float(200 - 200 * np.cos(t))) for i, t in enumerate(a)]
    line = [("l", i, i * 3.0, 0.0) for i in range(61)]
    df = spark.createDataFrame(arc + line, "route_id string, idx int, x double, y double")
    k = curves.headings(curves.curvature(df, step=3.2))
    mid = k.where("route_id = 'c' and idx = 30").first()
    assert mid.kappa == pytest.approx(1 / 200, rel=0.01)
    found = curves.horizontal_curves(k, Params(h_max_radius_ft=2000.0), step=3.2).collect()
    assert {r.route_id for r in found} == {"c"} and found[0].bin in "DE" and found[0].dir == "Right" and found[0].delta > 40


def test_intervals_and_distances_meet_brute_force(spark):
    rng = np.random.default_rng(3)
    s = [("r", i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(rng.uniform(0, 900, 60), rng.uniform(0, 400, 60), strict=True))]
    c = [("r", i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(rng.uniform(0, 900, 60), rng.uniform(0, 300, 60), strict=True))]
    left, right = spark.createDataFrame(s, "route_id string, i int, s double, e double"), spark.createDataFrame(c, "route_id string, j int, cs double, ce double")
    got = {(r.i, r.j) for r in intervals.overlap_pairs(left, right, ["route_id"], "s", "e", "cs", "ce").collect()}
    assert got == {(i, j) for _, i, a, b in s for _, j, x, y in c if b > x and a < y}
    assert intervals.overlap_pairs(left, right, ["route_id"], "s", "e", "cs", "ce").count() == len(got)
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 5, (80, 2)))]
    a, b = spark.createDataFrame(p, "i int, x double, y double"), spark.createDataFrame(p, "j int, u double, v double")
    near = {(r.i, r.j) for r in spatial.within(a, b, "x", "y", "u", "v", 0.7).collect()}
    assert near == {(i, j) for i, x, y in p for j, u, v in p if np.hypot(x - u, y - v) <= 0.7}


def test_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('route_id,WKT\n1,"LINESTRING (0 0, 1 1)"\n2,\n')
    q = feed.keep(feed.stream(spark, str(tmp_path / "in"), "route_id string, WKT string"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.RouteId for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["1"]


def test_zm_and_filters(spark):
    z = spark.createDataFrame([("LINESTRING ZM (0 0 0 1, 1 1 0 2)",), ("LINESTRING ZM (0 0 5 0, 1 1 0 0)",), (None,)], "wkt_zm string")
    assert [(r.zero_z, r.zero_m) for r in cleaning.incomplete_zm(z).collect()] == [(True, False), (False, True), (False, False)]
    s = spark.createDataFrame([("1",), ("01",), ("53",)], "stateid string")
    assert cleaning.for_state(s, "1").count() == 2 and cleaning.for_state(s, "ALL").count() == 3
    with pytest.raises(ValueError):
        cleaning.route_clip(s, "r", 2, 1)
