"""Enrichment, attributes of vertices, intersections and slices against plain Python, under uneven data and partitions."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadgeo.kernels import projection
from roadgeo.operators import attributes as A
from roadgeo.operators import curves, intervals, nearest, spatial
from roadgeo.plans import enrichment, flow


def utm(lon, lat):
    """Forward projection to zone 10 by Newton steps on the inverse."""
    e, n = np.array([500_000.0]), np.array([5_000_000.0])
    for _ in range(30):
        x, y = projection.utm_inverse(e, n, 32610)
        e, n = e + (lon - x) * 78_000, n + (lat - y) * 111_000
    return float(e[0]), float(n[0])


def test_enriched_lines(spark):
    rng = np.random.default_rng(2)
    vertices = [("A", 0.0, "A/1", k, 32610, -120.40 + k * 1e-4, 45.20 + 5e-5 * math.sin(k / 3), 100.0 + k) for k in range(150)]
    vertices += [("A", 5.0, "A/2", k, 32611, -120.30 + k * 1e-4, 45.30, 500.0 + k) for k in range(40)] + [("B", 0.0, "B/1", 0, 32610, -120.2, 45.2, 7.0)]
    line = lambda n: [(round(-120.40 + float(x), 7), round(45.20 + float(y), 7)) for x, y in zip(np.sort(rng.uniform(0, 0.013, n)), rng.uniform(-1e-3, 1e-3, n), strict=True)]
    text = lambda p: "(" + ", ".join(f"{x:.7f} {y:.7f}" for x, y in p) + ")"
    parts = {1: [line(5)], 2: [line(4), line(1), line(3)], 3: [[(-120.29, 45.31), (-119.0, 46.0)]], 4: [[(-120.2, 45.2), (-120.2, 45.2)]]}
    wkt = {k: "LINESTRING " + text(p[0]) if len(p) == 1 else f"MULTILINESTRING ({', '.join(map(text, p))})" for k, p in parts.items()}
    rows = [(1, "A", 0.0, 1.0, wkt[1]), (2, "A", 1.0, 3.5, wkt[2]), (3, "A", 9.0, 8.0, wkt[3]), (4, "B", 0.0, 1.0, wkt[4]), (5, "A", 1.0, 3.5, wkt[2])]
    rows += [(6, "C", 0.0, 2.0, "MULTILINESTRING ((-120.4 45.2, -120.3 45.2), (-120.3 45.3, -120.3 45.4))"), (7, "C", 0.0, 2.0, "LINESTRING (-120.4 45.2)"), (8, "A", 0.0, 1.0, None), (9, "A", 0.0, 1.0, "LINESTRING (x 1, 2 3)"), (10, "A", 0.0, 1.0, "POINT (1 2)")]
    sections = spark.createDataFrame([(*r, "note") for r in rows], "id long, RouteId string, Start_MP double, End_MP double, WKT string, section string")
    v = spark.createDataFrame(vertices, "RouteId string, low double, path string, idx int, epsg int, lon double, lat double, z double")
    raster = spark.createDataFrame([("n46w121", 1919, 1440, 33.5), ("n46w121", 1919, 1680, -9999.0)], "tile string, row int, col int, z double")
    got = {r.id: (r.WKT_ZM, r.Elevation_Source) for r in enrichment.enriched(sections, v, raster).collect()}
    assert len(got) == len(rows) and all(got[k] == (None, None) for k in (7, 8, 9, 10)) and got[5] == got[2]
    assert got[6][1] == "raw_fallback"
    zm = lambda k: [tuple(map(float, p.split())) for p in got[k][0].removeprefix("LINESTRING ZM (").rstrip(")").split(", ")]
    # Degrees, with the way from part to part: 0.1, 0.1, 0.1.
    assert zm(6) == [(-120.4, 45.2, 33.5, 0.0), (-120.3, 45.2, 0.0, 0.6667), (-120.3, 45.3, 0.0, 1.3333), (-120.3, 45.4, 0.0, 2.0)] or zm(6)[0][2] in (33.5, 0.0)
    place = {r[:4]: utm(r[5], r[6]) for r in vertices}
    for k, route, start, end, _ in rows[:4]:
        flat, at, total = [], [], 0.0
        for p in parts[k]:
            for i, q in enumerate(p):
                xy = utm(*q)
                total += math.dist(xy, before) if i else 0.0
                before = xy
                flat.append((q, xy))
                at.append(total)
        assert got[k][1] == "smoothed" and len(zm(k)) == len(flat)
        for (q, xy), d, (lon, lat, z, m) in zip(flat, at, zm(k), strict=True):
            best = min((math.dist(xy, place[r[:4]]), r[1], r[3], r[7]) for r in vertices if r[0] == route)
            assert (lon, lat, z) == (q[0], q[1], best[3]) and m == pytest.approx(start + (d / total if total else 0.0) * (end - start), abs=2e-4)
    assert enrichment.enriched(sections.limit(0), v, raster).count() == 0
    assert {r.Elevation_Source for r in enrichment.enriched(sections.where("id < 3"), v.limit(0), raster).collect()} == {"raw_fallback"}


def test_last_interval_that_holds():
    rng = np.random.default_rng(0)
    for n, m in ((0, 5), (1, 50), (40, 300), (300, 300)):
        s = rng.integers(0, 60, n).astype(float)
        e = s + rng.integers(0, 20, n)
        at = rng.choice(np.arange(-2, 90, 0.5), m)
        want = [max((i for i in range(n) if s[i] <= x <= e[i]), default=-1) for x in at]
        assert A.last_holding(at, s, e).tolist() == want


@pytest.mark.parametrize("piece", [A.PIECE, 7])
def test_attributes_are_those_of_separate_joins(spark, piece):
    rng = np.random.default_rng(1)
    points = [(p, i, i * 2.0, 10 + i * 0.5) for p, n in (("long", 60), ("short", 3), ("bare", 4)) for i in range(n)]
    rows = [("long", n, axis, float(a), float(a + b), float(k), 0.0, None if k % 9 == 0 else f"{n}{k}") for n, axis, far in (("one", "d", 120), ("two", "mp", 40)) for k, (a, b) in enumerate(zip(rng.integers(-5, far, 40), rng.integers(-3, 30, 40), strict=True))]
    rows += [("short", "one", "d", 2.0, 2.0, 1.0, 0.0, "x"), ("gone", "one", "d", 0.0, 9.0, 1.0, 0.0, "y")]
    df = spark.createDataFrame(points, "path string, idx int, d double, mp double")
    held = spark.createDataFrame(rows, "path string, name string, axis string, s double, e double, a double, b double, v string")
    every = None
    for n, axis in (("one", "d"), ("two", "mp")):
        part = held.where(F.col("name") == n).select(*A.interval(n, axis, "s", "e", ["a", "b"], "v"))
        every = part if every is None else every.unionByName(part)
    got = {(r.path, r.idx): (r.one, r.two) for r in A.attributes(df, every, "path", "idx", ["d", "mp"], ["one", "two"], piece).collect()}
    last = lambda path, n, x: max(((a, v) for p, name, _, s, e, a, _, v in rows if p == path and name == n and s <= x <= e), key=lambda t: t[0], default=(0, None))[1]
    assert got == {(p, i): (last(p, "one", d), last(p, "two", mp)) for p, i, d, mp in points}


def test_slices_are_those_of_their_own_curves(spark):
    """As many curves as make adaptive execution merge the two sides' partitions differently."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        base = spark.range(12_000).select(F.concat(F.lit("p"), F.col("id") % 400).alias("path"), (F.col("id") % 37 * 3).cast("double").alias("s"), F.lit("x" * 40).alias("pad"), "id")
        c = base.groupBy("path", "s", "id").agg((F.max("s") + 4 + F.max("id") % 3).alias("e"), F.max("pad").alias("pad"))  # an aggregate's output, as curves are
        points = spark.range(400).select(F.concat(F.lit("p"), F.col("id")).alias("path"), F.explode(F.sequence(F.lit(0), F.lit(130))).alias("idx")).selectExpr("path", "idx", "cast(hash(path) as double) x", "cast(idx as double) y")
        out = curves.sliced(c, points, "path", "s", "e", "idx")
        bad = out.where("points is null or points[0].y <> s or element_at(points, -1).y <> floor(e) or points[0].x <> hash(path) or size(points) <> floor(e) - s + 1").count()
        assert bad == 0 and out.count() == 12_000
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)


def test_pairs_where_one_cell_holds_half_of_all(spark):
    rng = np.random.default_rng(9)
    points = [(k, *map(float, rng.uniform(0, 0.9, 2))) for k in range(150)] + [(k, *map(float, rng.uniform(-30, 30, 2))) for k in range(150, 300)]
    a = spark.createDataFrame(points, "i int, x double, y double")
    b = spark.createDataFrame(points, "j int, u double, v double")
    pairs = spatial.within_dense(a, b, "x", "y", "u", "v", 1.0, slices_of=20)
    got = [(r.i, r.j) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, x, y in points for j, u, v in points if math.hypot(x - u, y - v) <= 1.0}


def test_intersections(spark):
    v = [("A", "A/1", k, -120.0 + k * 1e-5, 45.0, 100.0, k / 10) for k in range(50)] + [("B", "B/1", k, -119.9998, 45.0 - 2e-4 + k * 1e-5, 103.0, 5 + k / 10) for k in range(40)]
    v += [("C", "C/1", k, -119.9996, 45.0 - 2e-4 + k * 1e-5, 107.0, k / 10) for k in range(40)] + [("D", "D/1", k, -119.9997, 45.0 - 2e-4 + k * 1e-5, 120.0, k / 10) for k in range(40)]
    df = spark.createDataFrame([(0.0, *r) for r in v], "low double, RouteId string, path string, idx int, lon double, lat double, Elev_Ft double, Milepost double")
    got = {(r.Route_A, r.Route_B): r for r in flow.intersections(df).collect()}
    near = lambda a, b: [(p, q) for p in v if p[0] == a for q in v if q[0] == b and math.hypot(p[3] - q[3], p[4] - q[4]) <= 4.5e-5]
    assert set(got) == {("A", "B"), ("A", "D")}  # C is 7 feet above A: neither kind
    for (a, b), r in got.items():
        p, q = min(near(a, b), key=lambda t: (t[0][2], t[1][2]))
        assert (r.MP_A, r.MP_B, r.Elev_A_Ft, r.Elev_B_Ft, r.Lon, r.Lat) == (p[6], q[6], p[5], q[5], p[3], p[4])
        assert r.Topology_Node == ("At-Grade" if b == "B" else "Grade-Separated") and r.Elev_Diff_Ft == abs(p[5] - q[5])


def test_repeated_sections_and_held_points(spark):
    s = spark.createDataFrame([("r", 1, 0.0, 1.0)] * 3 + [("r", 1, 2.0, 1.0), ("q", None, 0.0, 5.0)], "RouteId string, FSystem int, Start_MP double, End_MP double")
    curve = lambda rows: spark.createDataFrame(rows, "RouteId string, start_mp double, end_mp double, bin string")
    got = sorted((r.RouteId, r.start_mp, r.h_bin, r.v_bin) for r in flow.scored(s, curve([("r", 0.5, 1.5, "C"), ("r", 0.0, 0.1, "B")]), curve([("r", 1.2, 1.3, "F")])).collect())
    assert got == [("q", 0.0, "A", "A"), *[("r", 0.0, "C", "A")] * 3, ("r", 1.0, "C", "F")]
    i = spark.createDataFrame([("a", 0.0, 1.0), ("a", 5.0, 6.0), ("b", 0.0, 50.0)], "k string, s double, e double")
    p = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 77.0), ("b", 49.0), ("c", 0.5)], "k string, x double")
    assert {tuple(r) for r in intervals.holding(i, p, "k", "s", "e", "x").collect()} == {("a", 0.0, 1.0), ("b", 0.0, 50.0)}


def first_of_all(nodes, radius, crossing):
    """The first pair of every two routes, from all pairs."""
    best = {}
    for i, r, x, y, z in nodes:
        for j, s, u, v, w in nodes:
            if math.sqrt((x - u) ** 2 + (y - v) ** 2) > radius or (not r < s or 5 < abs(z - w) <= 10 if crossing else r == s or i >= j):
                continue
            pair = (min(r, s), max(r, s))
            best[pair] = min(best.get(pair, (i, j)), (i, j))
    return best


@pytest.mark.parametrize("crossing", [True, False])
def test_first_pairs_of_dense_and_of_scattered_nodes(spark, crossing):
    rng = np.random.default_rng(11)
    places = [(0.3 * k, 0.0) for k in range(5)]
    nodes = [(k, f"r{int(rng.integers(5))}", *places[int(rng.integers(5))], float(rng.integers(30))) for k in range(300)]
    nodes += [(k, f"r{int(rng.integers(9))}", *map(float, rng.uniform(-3, 3, 2)), float(rng.integers(30))) for k in range(300, 500)]
    # Two routes whose early nodes are neither level with nor clear of the other's, and meet by a late one alone.
    nodes += [(500 + k, "x" if k % 2 else "y", 50.0, 50.0, 7.0 * (k % 2) if k < 38 else 0.0) for k in range(40)]
    got = {}
    for r in spatial.first_pairs(spark.createDataFrame(nodes, "node_id int, route_id string, lon double, lat double, elev double"), 1.0, crossing).collect():
        got[min(r.route_id, r.o_route_id), max(r.route_id, r.o_route_id)] = (r.node_id, r.o_node_id)
        assert r.dz == abs(r.elev - r.o_elev)
    assert got == first_of_all(nodes, 1.0, crossing) and ("x", "y") in got


def test_first_pairs_at_one_place_of_very_many_nodes(spark):
    """Sixteen hundred million pairs, of which one is asked for."""
    n = spark.range(80_000).selectExpr("id AS node_id", "cast(id % 2 AS string) route_id", "1.0D lon", "2.0D lat", "0.0D elev")
    for crossing in (True, False):
        assert [(r.node_id, r.o_node_id, r.dz) for r in spatial.first_pairs(n, 1.0, crossing).collect()] == [(0, 1, 0.0)]


def test_nearest_of_very_many_points_at_one_place(spark):
    """Sixteen hundred million pairs, if points met and not places."""
    a, b = spark.range(40_000).selectExpr("id AS k", "0.0D x", "0.0D y"), spark.range(40_000).selectExpr("40000 - id AS o", "if(id % 2 = 0, 0.1D, 0.2D) u", "0.0D v")
    got = spatial.nearest(a, b, "k", "o", "x", "y", "u", "v", 1.0)
    assert got.agg(F.count("*"), F.countDistinct("k"), F.min("o"), F.max("o"), F.max("dist")).first() == (40_000, 40_000, 2, 2, 0.1)


def test_nearest_of_all_for_very_many_points_at_one_place(spark):
    """From the middle of a circle no box can be left out: 160 million distances, if points went down the tree and not their place."""
    a = spark.range(80_000).selectExpr("id AS k", "0.0D x", "0.0D y")
    b = spark.range(2000).selectExpr("2000 - id AS o", "cos(id * 0.003D) u", "sin(id * 0.003D) v")
    got = nearest.nearest_of_all(a, b, "k", "o", "x", "y", "u", "v")
    assert got.agg(F.count("*"), F.countDistinct("k"), F.min("o"), F.max("o"), F.max("dist")).first() == (80_000, 80_000, 1, 1, 1.0)


def test_topology_pairs_move_lists_of_nodes_not_copies(spark):
    """All pairs of places with many nodes, of several routes, with repeated ids and nulls; they are made by several tasks, and nodes are neither copied to nine cells nor broadcast."""
    rng = np.random.default_rng(12)
    at = [(0.0, 0.0)] * 150 + [(3e-5, 0.0)] * 60 + [tuple(map(float, rng.uniform(-2e-4, 2e-4, 2))) for _ in range(150)]
    rows = [(int(k if k % 50 else 7), None if k == 11 else str(k % 4), x, y, None if k % 40 == 3 else float(rng.integers(0, 40))) for k, (x, y) in enumerate(at)] + [(None, "1", 0.0, 0.0, 1.0), (900, "2", None, 0.0, 1.0)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    nodes = spark.createDataFrame(rows, "node_id long, route_id string, lon double, lat double, elev double")
    radius = 4.5e-5
    pairs = spatial.topology_pairs(nodes, radius, slices_of=20)
    want = Counter()
    for a in rows:
        for b in rows:
            if None not in (*a[:4], *b[:4]) and a[0] < b[0] and a[1] != b[1] and math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) <= radius:
                want[(*a, *b, None if a[4] is None or b[4] is None else abs(a[4] - b[4]))] += 1
    names = ("node_id", "route_id", "lon", "lat", "elev")
    assert Counter(tuple(r) for r in pairs.select(*names, *[f"o_{c}" for c in names], "dz").collect()) == want
    assert pairs.where("lon = 0 and o_lon = 0").select(F.spark_partition_id()).distinct().count() > 1
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    copied = [line for line in plan.splitlines() if "explode([-1,0,1])" in line.replace(" ", "")]
    assert copied and not any("node_id" in line for line in copied)
