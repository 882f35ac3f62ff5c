"""Values worked out by hand from the rules, for what the SQL twins share constants with."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadgeo.config import FEET_PER_METER, METERS_PER_MILE, Params
from roadgeo.functions import geo as G
from roadgeo.operators import cleaning as K
from roadgeo.operators import curves as C
from roadgeo.operators import spatial
from roadgeo.operators import statistics as S


@pytest.mark.parametrize(
    ("method", "peak", "n", "rise", "want"),
    [
        ("elbow", 0.255, 7, 0.339, 25 + 21 + 6), ("elbow", 0.9, 15, 3.0, 100), ("elbow", 0.0, 3, 0.0, 9), ("highest_safe", 0.6, 2, 0.9, 50), ("highest_safe", 0.0, 2, 0.1, 6 + 2),
        ("composite_fallback", 0.6, 9, 1.0, 25), ("composite_fallback", 0.0, 0, 0.0, 0), ("flat_curve", 0.4, 10, 0.1, 50), ("absolute_fallback", 0.4, 10, 1.0, 5), ("flat_terrain_default", 0.0, 10, 0.04, 30),
    ],
)
def test_confidence(spark, method, peak, n, rise, want):
    assert spark.range(1).select(S.confidence(F.lit(method), F.lit(peak), F.lit(n), F.lit(rise))).first()[0] == want


def gates(spark, rows):
    return spark.createDataFrame([(g, f, float(r), 1.0, p) for g, f, r, p in rows], "grp int, factor int, rmse double, dev_p80 double, passed boolean")


def test_selection(spark):
    rows = [(1, f, 1.0, True) for f in (100, 200, 400)]  # flat: the default of functional system 1
    rows += [(5, f, 1.0 + f / 1e5, True) for f in (100, 200, 400)]  # flat, functional system 5
    rows += [(2, f, r, True) for f, r in ((100, 1.0), (200, 1.8), (400, 1.9), (800, 2.0))]  # bends at 200
    rows += [(3, 100, 1.0, True), (3, 200, 2.0, True), (3, 400, 9.0, False)]
    rows += [(4, 100, 8.0, False), (4, 200, 9.0, False)]
    got = {r.grp: (r.method, r.factor, r.passes, r.confidence) for r in S.selected(gates(spark, rows), "grp", "V", F.col("grp")).collect()}
    # Elbow of group 2: (0.8 - 1/7) / sqrt 2 = 0.4647, so 46 + 12 + 20.
    assert got == {1: ("flat_terrain_default", 1400, 3, 9), 5: ("flat_terrain_default", 1000, 3, 9), 2: ("elbow", 200, 4, 78), 3: ("highest_safe", 200, 2, 26), 4: ("composite_fallback", 100, 0, 0)}
    assert {r.method for r in S.selected(gates(spark, rows), "grp", "H", F.col("grp")).where("grp = 1").collect()} == {"elbow"}  # flat terrain is of profiles only


def test_early_exit_and_audit_row(spark):
    rows = [(2, 100, 1.0, True), (2, 200, 1.8, True), (2, 400, 1.9, True), (2, 800, 5.0, False), (2, 1600, 6.0, False), (2, 3200, 7.0, False), (2, 4500, 1.0, True)]
    rows += [(3, 100, 9.0, False), (3, 200, 8.0, False), (3, 400, 2.0, True)]
    ended = S.early_exit(gates(spark, rows), "grp")
    assert {(r.grp, r.factor) for r in ended.collect()} == {(2, f) for f in (100, 200, 400, 800, 1600, 3200)} | {(3, f) for f in (100, 200, 400)}
    a = {r.grp: r for r in S.audit_rows(ended, "grp", "V", F.col("grp")).collect()}
    two = a[2]
    assert (two.n_evaluated, two.n_passing, two.passing_factors, two.selected_factor, two.last_passing, two.national_default) == (6, 3, "100|200|400", 200, 400, 1400)
    assert (two.rmse_rise, two.deviation_from_default, two.ceiling_proximity_pct, two.rmse_at_last_passing, two.override_recommended) == (0.9, 0.143, 40.0, 1.9, False)
    three = a[3]
    assert (three.selection_method, three.selected_factor, three.rmse_at_baseline, three.override_recommended) == ("highest_safe", 400, 9.0, True)


def joint(spark, rows):
    """Metrics of factors: (system, factor, rmse and deviation up, rmse and deviation sideways)."""
    return spark.createDataFrame([(fs, f, 5, float(v), float(h), float(mv), float(mh), 0.5, 0.1, 0.2) for fs, f, v, h, mv, mh in rows], "FSystem int, factor int, n long, " + ", ".join(f"{c} double" for c in S.JOINT))


def test_audit_table(spark):
    rows = [(1, f, v, 1.0, 10.0, 9.0) for f, v in ((100, 1.0), (200, 1.8), (400, 1.9))] + [(1, 800, 5.0, 1.0, 10.0, 9.0), (1, 1000, 6.0, 1.0, 10.0, 9.0), (1, 1200, 7.0, 1.0, 10.0, 9.0), (1, 1400, 1.0, 1.0, 1.0, 1.0)]
    rows += [(2, 200, 4.0, 1.0, 38.0, 3.0), (2, 400, 5.0, 1.2, 39.0, 3.0)]  # within the ceiling of mountains alone
    rows += [(3, 100, 9.0, 0.5, 1.0, 1.0), (3, 200, 9.5, 0.6, 1.0, 1.0)]
    rows += [(5, f, 2.0 + f / 1e6, 0.5, 1.0, 1.0) for f in (100, 200, 400)]
    a = {r.FSystem: r for r in S.audit_table(joint(spark, rows), "FSystem", "V", F.col("FSystem"), F.lit(True)).collect()}
    one = a[1].asDict()
    assert [one[c] for c in ("v_rmse_ceiling", "h_rmse_ceiling", "maxv_ceiling", "maxh_ceiling", "n_evaluated", "n_passing", "passing_factors", "early_exit_factor", "last_passing_factor")] == [4.0, 3.5, 43.0, 15.0, 6, 3, "100|200|400", 400, 400]
    assert (one["selection_method"], one["selected_factor"], one["peak_elbow_distance"], one["rmse_rise"]) == ("elbow", 200, round((0.8 / 0.9 - 1 / 3) / math.sqrt(2), 4), 0.9)
    assert one["elbow_distance_profile"] == f"F100:0.0000  F200:{(0.8 / 0.9 - 1 / 3) / math.sqrt(2):.4f}  F400:0.0000"
    assert [one[f"{c}_at_selected"] for c in S.JOINT] == [1.8, 1.0, 10.0, 9.0, 0.5, 0.1, 0.2] and [one[f"{c}_at_baseline"] for c in S.JOINT[:5]] == [1.0, 1.0, 10.0, 9.0, 0.5] and [one[f"{c}_at_last_passing"] for c in S.JOINT[:4]] == [1.9, 1.0, 10.0, 9.0]
    assert (one["national_default_factor"], one["deviation_from_default"], one["ceiling_proximity_pct"], one["confidence_score"], one["override_recommended"]) == (1400, 0.143, 45.0, 39 + 9 + 18, False)
    two = a[2].asDict()
    assert (two["selection_method"], two["selected_factor"], two["n_passing"], two["passing_factors"], two["v_rmse_at_baseline"], two["elbow_distance_profile"]) == ("highest_safe", 200, 1, "200", 4.0, None)
    three = a[3].asDict()
    assert (three["selection_method"], three["selected_factor"], three["last_passing_factor"], three["v_rmse_at_last_passing"], three["early_exit_factor"], three["passing_factors"]) == ("composite_fallback", 100, None, None, None, "")
    five = a[5].asDict()
    assert (five["selection_method"], five["selected_factor"], five["v_rmse_at_selected"], five["ceiling_proximity_pct"], five["override_recommended"]) == ("flat_terrain_default", 1000, None, None, True)
    h = {r.FSystem: r for r in S.audit_table(joint(spark, rows), "FSystem", "H", F.col("FSystem"), F.lit(True)).collect()}
    assert (h[2].selection_method, h[2].selected_factor, h[2].h_rmse_at_selected, h[2].v_rmse_at_selected, h[2].ceiling_proximity_pct) == ("highest_safe", 400, 1.2, 5.0, round(1.2 / 3.5 * 100, 1))
    assert h[1].n_evaluated == 7 and h[1].passing_factors == "100|200|400|800|1000|1200|1400" and h[1].national_default_factor == 400
    chunks = spark.createDataFrame([(1, 100, float(k), 2.0 * k, 10.0 * k, 5.0 * k, 1.0) for k in range(1, 6)] + [(1, 200, 1.0, 1.0, 1.0, 1.0, 1.0)], "FSystem int, factor int, v_rmse double, h_rmse double, max_v_dev double, max_h_dev double, curve_var double")
    m = S.collated_joint(chunks, ["FSystem", "factor"]).collect()
    assert [(r.factor, r.n, r.v_rmse, r.h_rmse, r.maxv, r.maxh, r.curvevar, r.std_v_rmse, r.std_h_rmse) for r in m] == [(100, 5, 3.0, 6.0, 42.0, 21.0, 1.0, round(math.sqrt(2), 6), round(2 * math.sqrt(2), 6))]


def test_composite_rule(spark):
    rows = [(1, f, 1.0 + k * 0.05, True) for k, f in enumerate((100, 200, 400))] + [(2, 100, 9.0, False), (2, 200, 8.0, False), (2, 400, 8.5, False)]
    g = gates(spark, rows).withColumn("score", F.col("rmse"))
    assert {r.grp: (r.method, r.factor) for r in S.selected_composite(g, "grp").collect()} == {1: ("flat_curve", 100), 2: ("composite_fallback", 200)}
    worst = spark.createDataFrame([(5.0, 1.75, 30.0, 20.0, 0.02)], "v_rmse double, h_rmse double, v_dev double, h_dev double, curve_var double")
    # System 1: 40 + (5 / 4)^2 * 20 + (1.75 / 3.5)^2 * 20 + 500 * (1 + 5)
    assert worst.select(S.composite_score(F.lit(1), F.lit(False))).first()[0] == pytest.approx(40 + 31.25 + 5 + 3000)


def arc(radius, degrees, step, turn=1):
    n = int(radius * math.radians(degrees) / step)
    return [(radius * math.sin(i * step / radius), turn * (radius - radius * math.cos(i * step / radius))) for i in range(n)]


def test_horizontal_curves(spark):
    step = 1.5
    line = [(x * step - 600, 0.0) for x in range(400)]
    circle = [*line, *arc(200, 60, step)]
    a = arc(200, 45, step)
    (x0, y0), (x1, y1) = a[-2:]
    h = math.atan2(y1 - y0, x1 - x0)
    back = [(x1 + x * math.cos(h) - y * math.sin(h), y1 + x * math.sin(h) + y * math.cos(h)) for x, y in arc(200, 45, step, -1)[1:]]
    s_curve = [*line, *a, *back]
    straight = [(x * step, 3.0) for x in range(900)]
    paths = {"circle": circle, "s": s_curve, "straight": straight, "north": [(y, -x) for x, y in circle]}
    df = spark.createDataFrame([(k, i, float(x), float(y), step) for k, p in paths.items() for i, (x, y) in enumerate(p)], "route_id string, idx long, x double, y double, spacing double")
    got = C.horizontal_curves(C.headings(C.curvature(df, step="spacing")), Params(h_max_radius_ft=5000.0), step="spacing").collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: r.start_dist):
        by.setdefault(r.route_id, []).append(r)
    assert "straight" not in by and len(by["circle"]) == 1 and [r.dir for r in by["s"]] == ["Right", "Left"]
    for r in [*by["circle"], *by["north"]]:
        assert r.radius_m == r.min_radius_m == pytest.approx(200, rel=0.01) and r.delta == pytest.approx(60, abs=1.5) and r.bin == "D" and r.transition == "Simple" and r.banking == 8.0


def test_compound_curves(spark):
    mile = METERS_PER_MILE
    rows = [
        ("a", 1, 0.0, 0.1, "Left", 100.0, 0.1 * mile, 10.0, "Simple"), ("a", 2, 0.15, 0.25, "Left", 300.0, 0.1 * mile, 20.0, "Spiral"),  # 264 feet apart
        ("a", 3, 0.26, 0.3, "Right", 50.0, 0.04 * mile, 5.0, "Simple"), ("a", 4, 0.5, 0.6, "Right", 70.0, 0.1 * mile, 5.0, "Simple"),  # 1056 feet apart
        ("b", 5, 0.0, 1.0, "Left", 500.0, mile, 3.0, "Simple"), ("b", 6, 0.2, 0.3, "Left", 400.0, 0.1 * mile, 3.0, "Simple"), ("b", 7, 0.5, 0.6, "Left", 400.0, 0.1 * mile, 3.0, "Simple"),  # the gap is from the end of the one before
    ]
    df = spark.createDataFrame(rows, "route_id string, curve_id long, c_start double, c_end double, dir string, radius_m double, length_m double, delta double, transition string")
    got = {(r.route_id, r.c_start): r for r in C.compound_groups(df, 600.0).collect()}
    assert {k: (r.c_end, r.n, r.merge_status) for k, r in got.items()} == {("a", 0.0): (0.25, 2, "Compound"), ("a", 0.26): (0.3, 1, "Simple"), ("a", 0.5): (0.6, 1, "Simple"), ("b", 0.0): (0.3, 2, "Compound"), ("b", 0.5): (0.6, 1, "Simple")}
    first = got["a", 0.0]
    # The group weighs by its whole extent of 0.25 miles, the newcomer by its 0.1.
    assert first.radius_m == pytest.approx((100 * 0.25 + 300 * 0.1) / 0.35, abs=1e-3) and (first.delta, first.min_radius_m, first.transition, first.bin) == (30.0, 100.0, "Spiral", "E") and first.banking == 8.0
    assert got["b", 0.0].radius_m == pytest.approx((500 * 0.3 + 400 * 0.1) / 0.4, abs=1e-3)


def test_deviations_and_sensitivity(spark):
    rows = [(1, i, 45.0 + i * 1e-3, 45.0 + i * 1e-3 + 1e-5, 10.0, 10.0, 5.0 + i % 2, 5.0) for i in range(4)]
    df = spark.createDataFrame(rows, "chunk int, i int, lat double, lat_s double, lon double, lon_s double, z double, zs double")
    r = S.deviations(df, ["chunk"], ["i"]).first()
    assert r.v_rmse == pytest.approx(FEET_PER_METER * math.sqrt(0.5), abs=1e-5) and r.max_v_dev == pytest.approx(FEET_PER_METER) and r.h_rmse == r.max_h_dev == pytest.approx(3.64) and r.curve_var == 0
    vertices = spark.createDataFrame([(100, 1, i, float(h), 1.0, z) for i, (h, z) in enumerate(((0, 0.0), (10, 5.0), (30, 0.0)))], "factor int, chunk int, i int, heading double, z double, zs double")
    r = S.sensitivity(vertices, "factor", ["chunk"], "i", 5.0).first()
    assert r.h_variance == pytest.approx(np.var(np.radians([10, 20]) / 5), abs=1e-9) and r.v_variance == pytest.approx(1.0) and r.v_rmse == pytest.approx(math.sqrt(6) * FEET_PER_METER, abs=1e-5) and r.v_max == pytest.approx(4 * FEET_PER_METER)


def test_projection_there_and_back(spark):
    pts = [(-120.4, 45.2), (3.0, -10.5), (179.9, 70.0), (-0.001, 0.001), (9.0, 0.0)]
    df = spark.createDataFrame(pts, "lon double, lat double").withColumn("epsg", G.utm_zone(F.col("lon"), F.col("lat")))
    e, n = G.utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    back = df.withColumns({"e": e, "n": n})
    lon, lat = G.utm_inverse(F.col("e"), F.col("n"), F.col("epsg"))
    for r in back.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2"), "e", "n").collect():
        assert abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8
    nine = back.where("lon = 9.0").select("e", "n").first()
    assert nine.e == pytest.approx(500_000, abs=1e-3) and nine.n == pytest.approx(0, abs=1e-3)


def test_raster_cells_and_voids(spark):
    points = spark.createDataFrame([(1, -120.3999, 45.1999), (2, -120.3998, 45.1999), (3, -120.3999, 45.9999), (4, 10.5001, -3.2501), (5, -120.3999, 46.2)], "id int, lon double, lat double")
    cell = lambda lon, lat: (int((math.floor(lat) + 1 - lat) * 2400), int((lon - math.floor(lon)) * 2400))
    rows = [("n46w121", *cell(-120.3999, 45.1999), 100.0), ("n46w121", *cell(-120.3999, 45.9999), -9999.0), ("s04e011", *cell(10.5001, -3.2501), -5.0)]
    got = {r.id: r.z for r in spatial.sampled(points, spark.createDataFrame(rows, "tile string, row int, col int, z double"), "lon", "lat", "z").collect()}
    assert got == {1: 100.0, 2: 100.0, 3: None, 4: -5.0, 5: None}


def test_report(spark):
    good = spark.createDataFrame([("1", 0.0, 1.0, "A")], "route_id string, start_mp double, end_mp double, h_bin string")
    bad = good.withColumn("end_mp", F.lit(-1.0))
    rows = K.report({"good": (good, K.SCORE_RULES, ["route_id"], ["end_mp"])}).collect()
    assert [r.passed for r in rows if r.check == "result"] == [True] and {r.value for r in rows if r.check == "max of end_mp"} == {1.0}
    rows = K.report({"good": (good, K.SCORE_RULES, ["route_id"], []), "bad": (bad, K.SCORE_RULES, ["route_id"], [])}).collect()
    assert [r.passed for r in rows if r.check == "result"] == [False] and [(r.table_name, r.check) for r in rows if not r.passed] == [("bad", "order"), ("", "result")]
