"""Registered queries do the whole job: nothing is cut off before or after."""

from __future__ import annotations

import numpy as np
import pytest

from roadgeo import registry
from roadgeo.config import SWEEP_FACTORS
from roadgeo.operators import nearest, order
from roadgeo.queries import flow as flow_queries


def test_ampersands_beyond_the_first_2000_characters(spark, tmp_path):
    html = "a&b" + "x" * 3000 + "&lt; & &copy &#38; &&amp;"
    spark.createDataFrame([(1, html), (2, None)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["item"]: r.clean for r in registry.QUERIES["ampersand_sanitize"](spark, str(tmp_path)).collect()}
    assert got == {1: "a&amp;b" + "x" * 3000 + "&lt; &amp; &amp;copy &#38; &amp;&amp;", 2: None}


@pytest.mark.parametrize("cap", [nearest.CAP, 4])
def test_nearest_however_far(spark, monkeypatch, cap):
    monkeypatch.setattr(nearest, "CAP", cap)
    monkeypatch.setattr(nearest, "FAN", cap)
    monkeypatch.setattr(nearest, "A_RANGE", 10 * cap)
    rng = np.random.default_rng(3)
    right = np.concatenate((rng.normal(0, 0.01, (300, 2)), rng.integers(0, 5, (200, 2)) * 1.0, [[40.0, -3.0]]))
    left = np.concatenate((rng.normal(0, 0.02, (200, 2)), rng.uniform(-60, 60, (100, 2)), [[500.0, 500.0], [-1e5, 3.0], [2.5, 2.5]]))
    df = lambda a, k, x, y: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], f"{k} long, {x} double, {y} double")
    d = np.floor(np.sqrt(((left[:, None] - right) ** 2).sum(axis=2)) * 1e9 + 0.5) / 1e9
    want = {i: (int(row.argmin()), row.min()) for i, row in enumerate(d)}
    got = {r.a: (r.b, r.dist) for r in nearest.nearest_of_all(df(left, "a", "x", "y"), df(right, "b", "u", "v"), "a", "b", "x", "y", "u", "v").collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-6 for i in want)
    assert nearest.nearest_of_all(df(left, "a", "x", "y"), df(right, "b", "u", "v").limit(0), "a", "b", "x", "y", "u", "v").collect() == []


@pytest.mark.parametrize("cap", [nearest.CAP, 3])
def test_nearest_of_the_same_group(spark, monkeypatch, cap):
    monkeypatch.setattr(nearest, "CAP", cap)
    monkeypatch.setattr(nearest, "FAN", cap)
    monkeypatch.setattr(nearest, "A_RANGE", 10 * cap)
    rng = np.random.default_rng(4)
    sizes = {"a": 400, "b": 30, "c": 1, "e": 0}  # one group with most of all points, and one without any
    right = [(g, i, *map(float, rng.normal(0, 3, 2))) for g, n in sizes.items() for i in range(n)] + [("a", 900 + k, 1.0, 1.0) for k in range(20)]  # and one position many times
    left = [(g, k, *map(float, rng.uniform(-20, 20, 2))) for g in "abcde" for k in range(40)] + [("a", 77, 1.0, 1.0), ("a", 78, float("nan"), 0.0), (None, 79, 0.0, 0.0)]
    l = spark.createDataFrame(left, "g string, a long, x double, y double")  # noqa: E741
    r = spark.createDataFrame(right, "g string, b long, u double, v double")
    got = {tuple(x.p): (x.b, x.dist) for x in nearest.nearest_of_all(l.selectExpr("g", "struct(g, a) p", "x", "y"), r, "p", "b", "x", "y", "u", "v", "g").collect()}
    want = {}
    for g, k, x, y in left:
        own = [(np.floor(np.hypot(u - x, v - y) * 1e9 + 0.5) / 1e9, b) for h, b, u, v in right if h == g]
        if own and np.isfinite(x):
            want[g, k] = min(own)[::-1]
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_total_over_ranges(spark, monkeypatch, inclusive):
    monkeypatch.setattr(order, "LEAST", 3)
    rng = np.random.default_rng(6)
    rows = [(None if k % 11 == 0 else int(rng.integers(0, 20)), k, None if k % 7 == 0 else int(rng.integers(-5, 50))) for k in range(400)]
    df = spark.createDataFrame(rows, "age long, id long, n long")
    total, want = 0, {}
    for age, k, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[k] = total + (n or 0) * inclusive
        total += n or 0
    out = order.running_total(df, ["age", "id"], "n", "sum", inclusive, 16)
    assert {r.id: r["sum"] for r in out.collect()} == want
    assert order.running_total(df.limit(0), ["age", "id"], "n", "sum").count() == 0
    assert df.select(order.range_of(df, ["age", "id"], 16)).distinct().count() > 8


def test_every_node_has_a_smoothed_vertex(spark):
    assert registry.QUERIES["raw_to_smooth_nearest"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()


def test_tiles_of_every_point(spark, tmp_path):
    keys = [31, 61, 32, 17000]  # boxes of two points and of one, far from 0, 0
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    at: dict = {}
    for k in keys:
        at.setdefault(k % 30, []).append((k * 37 % 35900 / 100 - 179.5, k * 91 % 15900 / 100 - 79.5))
    want = {(g, x, y) for g, p in at.items() for x in range(int(np.floor(min(p)[0])), int(np.ceil(max(p)[0])) + 1) for y in range(int(np.floor(min(q[1] for q in p))), int(np.ceil(max(q[1] for q in p))) + 1)}
    got = [tuple(r) for r in registry.QUERIES["tiles_for_bbox"](spark, str(tmp_path)).select("grp", "tx", "ty").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sweep_of_all_factors(spark):
    by: dict = {}
    for r in registry.QUERIES["calibration_sweep"](spark, "/root/testdata/sf0.01").collect():
        by.setdefault(r.chunk, []).append(r.factor)
    assert len(by) >= 25 and len(SWEEP_FACTORS) == 15 and all(sorted(f) == sorted(SWEEP_FACTORS) for f in by.values())


def test_vertices_five_feet_apart(spark):
    rows = registry.QUERIES["alignment"](spark, "/root/testdata/sf0.001").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.path, []).append((r.idx, r.x, r.y))
    for v in by.values():
        p = np.array(sorted(v))[:, 1:]
        assert np.median(np.hypot(*np.diff(p, axis=0).T)) < 1.6  # metres


def test_sections_keep_their_own_vertices(spark):
    d = "/root/testdata/sf0.001"
    lines = {(r.RouteId, r.Start_MP): r.WKT for r in flow_queries.sections(spark, d).collect()}
    rows = registry.QUERIES["enrich_4d"](spark, d).collect()
    assert len(rows) == len(lines)
    for r in rows:
        own = [" ".join(p.split()[:2]) for p in r.WKT_ZM.removeprefix("LINESTRING ZM (").rstrip(")").split(", ")]
        assert r.Elevation_Source == "smoothed" and f"LINESTRING ({', '.join(own)})" == lines[r.RouteId, r.Start_MP]


def test_routes_beyond_the_first_100000(spark, tmp_path):
    spark.range(200_100).selectExpr("id % 100050 as l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = [r.route_id for r in registry.QUERIES["distinct_routes"](spark, str(tmp_path)).collect()]
    assert got == sorted(str(i) for i in range(100_050))
