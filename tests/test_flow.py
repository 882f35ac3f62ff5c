"""The alignment flow over a small made-up network: every stage after the kernels against plain Python on what went in."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadgeo.config import FEET_PER_METER, Params
from roadgeo.kernels import profile, projection, smooth
from roadgeo.plans import alignment, calibration, flow

LON, LAT = -120.4, 45.2
WIDE = 111_320 * math.cos(math.radians(LAT))  # metres of a degree of longitude


def wkt(points):
    return "LINESTRING (" + ", ".join(f"{LON + x / WIDE:.8f} {LAT + y / 111_320:.8f}" for x, y in points) + ")"


@pytest.fixture(scope="module")
def network(spark):
    bend = [(600 + 200 * math.sin(a), 200 - 200 * math.cos(a)) for a in np.linspace(0, math.pi / 2, 60)]
    path = [(x, 0.0) for x in np.linspace(0, 600, 40)] + bend[1:] + [(800.0, 200.0 + y) for y in np.linspace(10, 800, 60)]
    cut = [0, 30, 70, 110, len(path) - 1]
    rows = [("A", 1, k * 0.25, (k + 1) * 0.25, 1 if k == 3 else 0, wkt(path[a : b + 1][:: -1 if k == 1 else 1])) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
    rows += [("B", 2, 0.0, 0.5, 0, wkt([(0, 5000), (800, 5000)])), ("C", 1, 0.0, 0.1, 0, wkt([(0, 9000), (3, 9000)])), ("D", 1, 0.0, 0.4, 0, wkt([(0, -40_000), (600, -40_000)])), ("E", 1, 0.0, 1.0, 0, None), ("F", 3, 0.0, 0.5, 0, wkt([(0, 7000), (800, 7000)]))]
    sections = spark.createDataFrame(rows, "RouteId string, FSystem int, Start_MP double, End_MP double, Structure_Type int, WKT string")
    bridge = (400.0, 5000.0)
    structures = spark.createDataFrame([(7, LON + bridge[0] / WIDE, LAT + bridge[1] / 111_320, "0435"), (8, LON + 1.0, LAT, "0500")], "structure_id long, lon double, lat double, vertical_clearance string")
    cells = [("n46w121", r, c, 100.0 + 1.7 * math.sin((c - 1440) / 5) + (r % 7) * 0.01) for r in range(1740, 1930) for c in range(1430, 1500)]
    raster = spark.createDataFrame(cells, "tile string, row int, col int, z double")
    a = flow.aligned(sections, structures, raster, Params(merge=True, h_max_radius_ft=5000.0, factors={"V_SMOOTH_FACTOR_FS2": 20}))
    yield a, rows
    a.release()


def test_chains_vertices_and_errors(network):
    a, _ = network
    v = a.vertices.toPandas()
    assert set(v.path) == {"A/1", "B/1", "F/1"} and v.groupby("path").idx.apply(lambda i: sorted(i) == list(range(len(i)))).all()
    errors = {r.path: r.error for r in a.errors.collect()}
    assert "too few points" in errors["C/1"] and "no elevation" in errors["D/1"] and len(errors) == 2
    own = v[v.path == "A/1"].sort_values("idx")
    assert own.Milepost.is_monotonic_increasing and own.Milepost.iloc[0] == 0 and own.Milepost.iloc[-1] == pytest.approx(1.0)
    assert own.dist_m.iloc[-1] == pytest.approx(600 + 100 * math.pi + 800, rel=0.01) and own.spacing.iloc[0] == pytest.approx(5 / FEET_PER_METER, rel=0.01)
    assert np.hypot((own.lon - own.lon_raw) * WIDE, (own.lat - own.lat_raw) * 111_320).max() < 15


def test_structures_and_clearance(network):
    a, _ = network
    v = a.vertices.toPandas()
    one = v[(v.path == "A/1")]
    assert set(one[(one.Milepost >= 0.75)].Structure_Tier) == {"1_HPMS"} and "1_HPMS" not in set(one[one.Milepost < 0.74].Structure_Tier)
    b = v[v.path == "B/1"]
    x, y = (b.lon - LON) * WIDE, (b.lat - LAT) * 111_320
    near = np.hypot(x - 400, y - 5000)
    assert set(b[near < 16.0].Structure_Tier) == {"2_NBI"} and "2_NBI" not in set(b[near > 17.5].Structure_Tier)
    assert b[near < 5].z.mean() > b[near < 5].z_raw.mean() + 2  # the deck, 4.35 m and four feet above the ground, as far as smoothing leaves it


def test_curves_tags_and_scores(network):
    a, rows = network
    h = a.horizontal.collect()
    assert len(h) == 1 and h[0].RouteId == "A" and h[0].dir == "Right" and h[0].min_radius_m == pytest.approx(200, rel=0.15) and h[0].delta == pytest.approx(90, abs=6)
    total = a.vertices.where("path = 'A/1'").agg(F.max("dist_m")).first()[0]
    assert h[0].start_mp == pytest.approx(h[0].start_dist / total) and h[0].end_mp == pytest.approx(h[0].end_dist / total) and h[0].Part == 0.0
    v = a.vertices.where("path = 'A/1'").toPandas().sort_values("idx")
    inside = (v.dist_m >= h[0].start_dist - 1e-6) & (v.dist_m <= h[0].end_dist + 1e-6)
    want = "Compound Right" if h[0].merge_status == "Compound" else "Right"
    assert set(v[inside].curve) == {want} and v[~inside].curve.isna().all()
    line = v[(v.idx >= math.floor(h[0].start_dist / v.spacing.iloc[0] + 1e-6)) & (v.idx <= math.floor(h[0].end_dist / v.spacing.iloc[0] + 1e-6))]
    assert [(p.x, p.y) for p in h[0].points] == list(zip(line.lon, line.lat, strict=True))
    scores = {(r.RouteId, r.start_mp): (r.h_bin, r.v_bin) for r in a.scores.collect()}
    assert len(scores) == len(rows)
    vertical = a.vertical.collect()
    for route, _, start, end, *_ in rows:
        worst = lambda curves: max([c.bin for c in curves if c.RouteId == route and end > c.start_mp and start < c.end_mp], default="A")  # noqa: E731, B023
        assert scores[route, start] == (worst(h), worst(vertical))
    assert any(c.RouteId == "F" and c.kind == "CREST" and not c.false_valley for c in vertical)
    f = a.vertices.where("RouteId = 'F'").toPandas()
    for c in vertical:
        own = f[(f.path == c.path) & (f.dist_m >= c.start_dist) & (f.dist_m <= c.end_dist)]
        if c.RouteId == "F" and len(own):
            assert set(own.V_Curve_Type) <= {"CREST", "SAG"} and (own.V_Grade_Bin >= "A").all()
    assert set(v[inside].H_Curve_Type) == {"Right"} and set(v[~inside].H_Curve_Type) == {"Tangent"} and set(v[~inside].H_Curve_Bin) == {"A"} and set(v[inside].H_Curve_Bin) == {h[0].bin}
    known = {r.path: r.t for r in a.vertices.where("Structure_Tier in ('1_HPMS', '2_NBI')").groupBy("path").agg(F.collect_list("Milepost").alias("t")).collect()}
    for c in vertical:
        assert c.false_valley == (c.kind == "SAG" and any(c.start_mp <= m <= c.end_mp for m in known.get(c.path, [])))


def test_sheets_of_a_route(spark, network):
    _, rows = network
    sections = spark.createDataFrame(rows, "RouteId string, FSystem int, Start_MP double, End_MP double, Structure_Type int, WKT string")
    none = spark.createDataFrame([], "structure_id long, lon double, lat double, vertical_clearance string")
    raster = spark.createDataFrame([("n46w121", r, c, 100.0) for r in range(1740, 1930) for c in range(1430, 1500)], "tile string, row int, col int, z double")
    s = flow.plan_profile(sections, none, raster, Params(), " a ", 0.0, 0.6)
    pages = s.pages.toPandas()
    v = s.alignment.vertices.select("path", "idx", "dist_m", "Milepost").toPandas()
    assert len(pages) == len(v) and pages.page.max() == int(v.dist_m.max() * FEET_PER_METER // 1500)
    for _, p in pages.groupby("page"):
        p = p.sort_values("idx")
        assert p.y.iloc[0] == pytest.approx(0, abs=1e-6) and p.y.iloc[-1] == pytest.approx(0, abs=1e-6)
        assert (p.x.min(), p.x.max()) == (pytest.approx(p.mp.min()), pytest.approx(p.mp.max()))
    assert s.blind.first().blind < 0.2
    s.alignment.release()
    with pytest.raises(ValueError, match="no sections"):
        flow.plan_profile(sections, none, raster, Params(), "Z")


def test_calibration_from_sections_to_audit(spark):
    rng = np.random.default_rng(5)
    rows = []
    for r in range(4):
        y = 3000.0 * r + np.cumsum(rng.normal(0, 1.5, 900))
        rows.append((f"R{r}", 1 if r < 3 else 2, 0.0, 5.0, 0, wkt(list(zip(np.arange(900) * 9.0, y, strict=True)))))
    sections = spark.createDataFrame(rows, "RouteId string, FSystem int, Start_MP double, End_MP double, Structure_Type int, WKT string")
    z = lambda r, c: 200 + 8 * math.sin(c / 6) + 2 * math.cos(r * c / 50)
    cells = spark.createDataFrame([("n46w121", r, c, z(r, c)) for r in range(1690, 1930) for c in range(1430, 1700)], "tile string, row int, col int, z double")
    p = Params(state="41")
    chunks = calibration.mile_chunks(flow.projected(alignment.stitch(alignment.pieces(sections), p)))
    got = [(r.chunk, float(np.hypot(np.diff(r.xs), np.diff(r.ys)).sum())) for r in chunks.collect()]
    assert len(got) >= 20 and all(c == pytest.approx(1609.34) or 800 <= c < 1609.34 for _, c in got)
    drawn = calibration.sample(chunks)
    assert {(r.FSystem, r.total_chunks, r.sample_chunks) for r in drawn.collect()} == {(r.FSystem, r.n, r.n) for r in chunks.groupBy("FSystem").agg(F.count("*").alias("n")).collect()}
    for mode in ("V", "H"):
        audit = {r.f_sys: r for r in calibration.audited(sections, cells, p, mode).collect()}
        assert set(audit) == {1, 2}
        for r in audit.values():
            assert r["mode"] == mode and r.state_fips == "41" and 1 <= r.n_evaluated <= 15 and r.n_passing <= r.n_evaluated and r.selected_factor in (*calibration.SWEEP_FACTORS, r.national_default_factor) and r.timestamp
            assert len(r) == 42 and (r.v_rmse_at_selected is None) == (r.h_rmse_at_selected is None)
            if r.n_passing:
                assert r.ceiling_proximity_pct <= 100 or r.selection_method == "flat_terrain_default"


def test_joint_metrics_of_a_chunk(spark):
    """Both modes against plain numpy on one chunk whose raster is known."""
    n, step = 400, 10 / FEET_PER_METER
    d = np.arange(n) * step
    rng = np.random.default_rng(8)
    x, y = 547_000 + d + rng.normal(0, 0.3, n), 5_005_500 + 40 * np.sin(d / 150) + rng.normal(0, 0.3, n)
    points = spark.createDataFrame([("c/0", 2, 32610, i, float(d[i]), step, float(x[i]), float(y[i])) for i in range(n)] + [("far/0", 2, 32610, i, float(d[i]), step, float(x[i]) + 50_000, float(y[i])) for i in range(n)], calibration.POINT)
    z = lambda r, c: 200 + 8 * math.sin(c / 2) + 2 * math.cos(r)
    lon, lat = projection.utm_inverse(x, y, 32610)
    row, col = projection.cells(lon, lat, 2400)
    held = {(r, c): z(r, c) for r in range(row.min() - 6, row.max() + 7) for c in range(col.min() - 6, col.max() + 7) if (r + c) % 9}
    cells = spark.createDataFrame([("n46w121", r - 44 * 2400, c - 59 * 2400, v) for (r, c), v in held.items()], "tile string, row int, col int, z double")
    p, factors = Params(factors={"H_SMOOTH_FACTOR_FS2": 60}), (30, 400)
    at = lambda lon, lat: np.array([held.get((r, c), np.nan) for r, c in zip(*projection.cells(lon, lat, 2400), strict=True)])
    for mode in "HV":
        got = {(r.chunk, r.factor): r for r in calibration.swept(points, cells, p, mode, factors).collect()}
        assert set(got) == {("c/0", f) for f in factors}  # the other chunk has no elevations
        for f in factors:
            h = f if mode == "H" else 60
            slon, slat = projection.utm_inverse(smooth.smoothing_spline(d, x, h), smooth.smoothing_spline(d, y, h), 32610)
            side = np.hypot((lat - slat) * 364_000, (lon - slon) * 364_000 * np.cos(np.radians(slat)))
            if mode == "H":
                up = (np.abs(at(lon, lat) - at(slon, slat)) * FEET_PER_METER)
                up = up[~np.isnan(up)]
            else:
                raw = smooth.filled(at(lon, lat))
                none = np.zeros(n, int)
                fixed, _ = profile.repair_dips(raw, profile.trend_of(raw, none, step, p), none, step, p)
                up = np.abs(smooth.smoothing_spline(d, fixed, f) - raw) * FEET_PER_METER
            turn = np.degrees(np.abs(np.diff(np.unwrap(np.arctan2(np.diff(slat), np.diff(slon)))))).mean()
            r = got["c/0", f]
            assert (r.v_rmse, r.max_v_dev) == (pytest.approx(math.sqrt((up**2).mean()), rel=1e-6), pytest.approx(up.max(), rel=1e-6))
            assert (r.h_rmse, r.max_h_dev, r.curve_var) == (pytest.approx(math.sqrt((side**2).mean()), rel=1e-4), pytest.approx(side.max(), rel=1e-4), pytest.approx(turn, rel=1e-6))


def test_curves_are_written_once(network):
    """Tags, scores and queries read curves; none looks for them again in all vertices."""
    a, _ = network
    own = a.folder.rsplit("/", 1)[-1]
    for table, name in ((a.horizontal, "horizontal"), (a.vertical, "vertical")):
        assert {f.rsplit("/", 2)[1] for f in table.inputFiles()} == {name} and all(own in f for f in table.inputFiles())
    assert {f.rsplit("/", 2)[1] for f in a.scores.inputFiles()} <= {"horizontal", "vertical"}


def test_one_kind_of_curves_waits_for_no_other(spark):
    sections = spark.createDataFrame([("B", 2, 0.0, 0.5, 0, wkt([(0, 5000), (400, 5100), (800, 5000)]))], "RouteId string, FSystem int, Start_MP double, End_MP double, Structure_Type int, WKT string")
    none = spark.createDataFrame([], "structure_id long, lon double, lat double, vertical_clearance string")
    raster = spark.createDataFrame([("n46w121", r, c, 100.0 + c % 9) for r in range(1740, 1930) for c in range(1430, 1500)], "tile string, row int, col int, z double")
    a = flow.aligned(sections, none, raster, Params())
    folder = Path(a.folder.removeprefix("file://"))
    names = lambda: {f.name for f in folder.iterdir()}
    assert names() == {"plan", "vertices"}
    assert a.vertical.inputFiles() and names() == {"plan", "vertices", "vertical"}
    assert a.vertical is a.vertical and a.scores.count() == 1 and names() == {"plan", "vertices", "vertical", "horizontal"}
    a.release()


def test_degrees_of_the_plan_and_sections_dealt_to_all_tasks(spark):
    sections = spark.createDataFrame([("B", 2, 0.0, 0.5, 0, wkt([(0, 5000), (400, 5100), (800, 5000)]))], "RouteId string, FSystem int, Start_MP double, End_MP double, Structure_Type int, WKT string").coalesce(1)
    parts = alignment.pieces(sections)
    assert parts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = flow.planned(flow.projected(alignment.stitch(parts, Params())), Params()).toPandas()
    lon, lat = projection.utm_inverse(v.x.to_numpy(), v.y.to_numpy(), 32610)
    assert np.allclose(v.lon, lon, atol=1e-12) and np.allclose(v.lat, lat, atol=1e-12) and (v.lon_raw.iloc[0], v.lat_raw.iloc[0]) == (pytest.approx(LON, abs=1e-7), pytest.approx(LAT + 5000 / 111_320, abs=1e-7))


def test_sampled_chunks_are_written_once(spark):
    x = np.arange(0, 8100, 90.0)
    sections = spark.createDataFrame([("A", 1, 0.0, 5.0, 0, wkt([(a, 0.0) for a in x]))], "RouteId string, FSystem int, Start_MP double, End_MP double, Structure_Type int, WKT string")
    drawn, at = calibration.drawn_points(sections, Params())
    assert drawn.inputFiles() and set(drawn.inputFiles()) == set(at.inputFiles())
    rows = sorted(drawn.collect(), key=lambda r: r.chunk)
    chain = flow.projected(alignment.stitch(alignment.pieces(sections), Params())).first()
    along = np.concatenate(([0.0], np.cumsum(np.hypot(np.diff(chain.xs), np.diff(chain.ys)))))
    assert len(rows) == 5 and rows[0].total_chunks == 5  # a chunk has the chain's points within its mile, and both its ends
    for i, r in enumerate(rows):
        assert len(r.xs) == 2 + int(((along > i * 1609.34) & (along < min((i + 1) * 1609.34, along[-1]))).sum())
