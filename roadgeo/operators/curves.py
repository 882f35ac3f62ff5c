"""Horizontal curves as runs of curvature, their spirals and merged groups; vertical fits; candidate dips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FEET_PER_METER, METERS_PER_MILE, SIGHT_EYE_FT, SIGHT_OBJECT_FT, SIGHT_SEARCH_FT, Params
from ..functions.classify import degree_bin, degree_of_curve, superelevation
from ..functions.sequence import gradient, islands, unwrap_step

#: Units of a window's width, for frames whose width differs by path.
SCALE = 1 << 36


def curvature(points: DataFrame, key: str = "route_id", order: str = "idx", x: str = "x", y: str = "y", step: float | str = 5.0) -> DataFrame:
    """kappa (size) and turn (signed numerator) by central differences, step apart (a number or a column); 0 where the path stands still."""
    step = F.col(step) if isinstance(step, str) else step
    w = Window.partitionBy(key).orderBy(order)
    a = points.withColumn("_x1", gradient(F.col(x), w, step)).withColumn("_y1", gradient(F.col(y), w, step))
    b = a.withColumn("_x2", gradient(F.col("_x1"), w, step)).withColumn("_y2", gradient(F.col("_y1"), w, step))
    turn, den = F.col("_x1") * F.col("_y2") - F.col("_y1") * F.col("_x2"), F.pow(F.col("_x1") * F.col("_x1") + F.col("_y1") * F.col("_y1"), 1.5)
    out = b.withColumn("turn", F.when(den > 1e-12, turn).otherwise(0.0)).withColumn("kappa", F.when(den > 1e-12, F.abs(turn) / den).otherwise(0.0))
    return out.drop("_x1", "_y1", "_x2", "_y2")


def headings(points: DataFrame, key: str = "route_id", order: str = "idx", x: str = "x", y: str = "y") -> DataFrame:
    """heading in degrees of each edge, the last one repeated, without jumps of whole turns."""
    w = Window.partitionBy(key).orderBy(order)
    edge = F.degrees(F.atan2(F.lead(y).over(w) - F.col(y), F.lead(x).over(w) - F.col(x)))
    h = points.withColumn("_h", edge).withColumn("_h", F.coalesce("_h", F.lag("_h").over(w)))
    fix = h.withColumn("_c", F.coalesce(unwrap_step(F.col("_h") - F.lag("_h").over(w)), F.lit(0.0)))
    return fix.withColumn("heading", F.col("_h") + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_h", "_c")


def horizontal_curves(points: DataFrame, p: Params, key: str = "route_id", order: str = "idx", step: float | str = 5.0) -> DataFrame:
    """Curves of each path: runs of curvature above the threshold and of one sign, trimmed, long and turned enough.

    points hold kappa, turn and heading. A sample with turn 0 goes on with the run it stands in. Left and right are by
    the sign of the turn, positive being called Right. A curve is a spiral if the run before or after its core (from the
    first to the last sample of 85 % of the peak) is longer than 150 feet. The radius is that of the peak.
    """
    points = points.withColumn("_step", F.col(step) if isinstance(step, str) else F.lit(step))
    step = F.col("_step")
    w = Window.partitionBy(key).orderBy(order)
    thr = 1 / p.metres("h_max_radius_ft")
    sign = F.when(F.col("turn") > 0, 1).when(F.col("turn") < 0, -1)
    s = points.withColumn("_on", F.col("kappa") >= thr).withColumn("_s", sign)
    s = s.withColumn("_gap", islands(~F.col("_on"), w)).where("_on")
    in_gap = Window.partitionBy(key, "_gap").orderBy(order)
    s = s.withColumn("_last", F.last("_s", ignorenulls=True).over(in_gap.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_new", F.col("_last").isNotNull() & F.col("_s").isNotNull() & (F.col("_s") != F.col("_last"))).withColumn("_run", islands(F.col("_new"), in_gap))
    run = [key, "_gap", "_run"]
    whole = Window.partitionBy(*run)
    s = s.withColumn("_peak", F.max("kappa").over(whole))
    keep, core = F.col("kappa") >= thr * 1.05, F.col("kappa") >= 0.85 * F.col("_peak")
    g = s.groupBy(*run).agg(
        F.min(F.when(keep, F.struct(order, "heading"))).alias("a"), F.max(F.when(keep, F.struct(order, "heading"))).alias("b"), F.max("kappa").alias("peak"),
        F.min(F.when(core, F.col(order))).alias("sc"), F.max(F.when(core, F.col(order))).alias("cs"), F.first("_s", ignorenulls=True).alias("side"), F.first("_step").alias("_step"),
    )
    start, end = F.col(f"a.{order}") * step, F.col(f"b.{order}") * step
    c = g.where("a is not null").select(key, start.alias("start_dist"), end.alias("end_dist"), F.greatest(F.col("sc") * step, start).alias("sc_dist"), F.least(F.col("cs") * step, end).alias("cs_dist"), (end - start).alias("length_m"), (1 / F.col("peak")).alias("radius_m"), (1 / F.col("peak")).alias("min_radius_m"), F.abs(F.col("b.heading") - F.col("a.heading")).alias("delta"), F.when(F.col("side") > 0, "Right").otherwise("Left").alias("dir"))
    c = c.where((F.col("end_dist") > F.col("start_dist")) & (F.col("length_m") >= p.metres("h_min_length_ft")) & (F.col("delta") >= p.h_min_delta) & (F.col("min_radius_m") <= p.metres("h_max_radius_ft")))
    tail = 150 / FEET_PER_METER
    spiral = ((F.col("sc_dist") - F.col("start_dist")) > tail) | ((F.col("end_dist") - F.col("cs_dist")) > tail)
    return c.withColumn("transition", F.when(spiral, "Spiral").otherwise("Simple")).withColumn("bin", degree_bin(degree_of_curve(F.col("min_radius_m")))).withColumn("banking", superelevation(F.col("min_radius_m")))


def compound_groups(curves: DataFrame, gap_ft: float, key: str = "route_id") -> DataFrame:
    """Curves that follow another of the same direction at less than gap_ft as one: extent, turn, tightest radius, blended radius, spiral if any is, class and banking.

    Curves are taken in the order of their starts, and a gap is from the end of the one before. The blended radius is
    folded in that order: that of the group so far weighs by its whole extent, gap and newcomer included.
    """
    w = Window.partitionBy(key).orderBy("c_start", "curve_id")
    new = F.coalesce((F.lag("dir").over(w) != F.col("dir")) | ((F.col("c_start") - F.lag("c_end").over(w)) * 5280 >= gap_ft), F.lit(True))
    g = curves.withColumn("grp", islands(new, w))
    each = F.array_sort(F.collect_list(F.struct("c_start", "curve_id", "c_end", "radius_m", "length_m")))
    m = g.groupBy(key, "grp").agg(F.count("*").alias("n"), each.alias("_each"), F.first("dir").alias("dir"), F.round(F.sum("delta"), 4).alias("delta"), F.round(F.min("radius_m"), 6).alias("min_radius_m"), F.bool_or(F.col("transition") == "Spiral").alias("_spiral"))

    def blend(radius, c):
        so_far = F.greatest((c["c_end"] - F.col("c_start")) * METERS_PER_MILE, F.lit(1e-6))
        own = F.greatest(c["length_m"], F.lit(1e-6))
        return (radius * so_far + c["radius_m"] * own) / (so_far + own)

    m = m.withColumn("c_start", F.col("_each")[0]["c_start"]).withColumn("c_end", F.element_at("_each", -1)["c_end"])
    m = m.withColumn("radius_m", F.aggregate(F.slice("_each", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0)).cast("int")), F.col("_each")[0]["radius_m"], blend))
    out = m.withColumn("merge_status", F.when(F.col("n") > 1, "Compound").otherwise("Simple")).withColumn("transition", F.when(F.col("_spiral"), "Spiral").otherwise("Simple"))
    out = out.withColumn("banking", superelevation(F.col("radius_m"))).withColumn("bin", degree_bin(degree_of_curve(F.col("min_radius_m"))))
    return out.withColumn("radius_m", F.round(F.col("radius_m") + 1e-9, 4)).select(key, "grp", "n", "c_start", "c_end", "dir", "delta", "min_radius_m", "radius_m", "merge_status", "transition", "banking", "bin")


def sight_distance(points: DataFrame, spacing_ft: float, key: str = "route_id", order: str = "idx", z: str = "z", scale: float = 1.0, search_ft: float = SIGHT_SEARCH_FT) -> DataFrame:
    """points with asd_ft: how far ahead, within search_ft, the farthest sample lies whose object an eye above this one sees over all ground between.

    z times scale is in feet, samples are spacing_ft apart. What lies ahead comes as a window frame of as many samples as
    the search distance holds, so a route is sorted once and never joined with itself. The eye's height is taken off last:
    in another order, lines of sight that just touch the ground would be decided by rounding.
    """
    w = Window.partitionBy(key).orderBy(order)
    n = int(search_ft / spacing_ft)
    slope = lambda h, k, up: (h * scale + up - F.col(z) * scale - SIGHT_EYE_FT) / ((k + 1) * spacing_ft)
    start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("asd"))

    def move(acc, s):
        top = F.greatest(acc["top"], s["ground"])
        return F.struct(top.alias("top"), F.when(s["target"] >= top, s["dist"]).otherwise(acc["asd"]).alias("asd"))

    ahead = points.withColumn("_ahead", F.collect_list(z).over(w.rowsBetween(1, max(n, 1))) if n >= 1 else F.array().cast("array<double>"))
    step = F.transform("_ahead", lambda h, k: F.struct(((k + 1) * spacing_ft).alias("dist"), slope(h, k, SIGHT_OBJECT_FT).alias("target"), slope(h, k, 0.0).alias("ground")))
    return ahead.withColumn("asd_ft", F.aggregate(step, start, move, lambda a: a["asd"])).drop("_ahead")


def mileposts(points: DataFrame, key: str, part: str, order: str) -> DataFrame:
    """points (x, y in metres, start_mp, end_mp) with dist_m, the length of the path before each, and milepost by its share of the whole; jumps from part to part have no length."""
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(Window.partitionBy(key, part).orderBy(order)), 2) + F.pow(F.col("y") - F.lag("y").over(Window.partitionBy(key, part).orderBy(order)), 2))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = points.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    s = s.withColumn("dist_m", F.sum("_step").over(w)).withColumn("_total", F.greatest(F.sum("_step").over(Window.partitionBy(key)), F.lit(1e-9)))
    return s.withColumn("milepost", F.col("start_mp") + F.col("dist_m") / F.col("_total") * (F.col("end_mp") - F.col("start_mp"))).drop("_step", "_total")


def sliced(curves: DataFrame, points: DataFrame, key: str, start: str, end: str, order: str, step: float | str = 1.0, block: int = 256) -> DataFrame:
    """curves with points (array of struct<x, y>) of their path from sample int(start / step) to int(end / step); those of one sample have none.

    Both sides are dealt to blocks of samples besides the path, so a long path with many curves is many tasks.
    """
    c = curves.withColumns({"_i": F.greatest(F.floor(F.col(start) / step), F.lit(0)), "_j": F.floor(F.col(end) / step)})
    span = [key, "_i", "_j"]  # what a slice depends on: curves of one span share it
    own = c.select(*span).distinct().withColumn("_b", F.explode(F.sequence(F.floor(F.col("_i") / block), F.floor(F.col("_j") / block))))
    at = points.select(key, F.col(order).alias("_o"), "x", "y").withColumn("_b", F.floor(F.col("_o") / block))
    hit = own.join(at, [key, "_b"]).where("_o between _i and _j").groupBy(*span).agg(F.array_sort(F.collect_list(F.struct("_o", "x", "y"))).alias("_all"))
    line = F.transform("_all", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    return c.join(hit, span, "left").withColumn("points", F.when(F.size("_all") > 1, line)).drop("_i", "_j", "_all")


def rolling(points: DataFrame, key: str, order: str, value: str, spacing: str, window_m: float) -> DataFrame:
    """points with rms and sd of a value over window_m: as many samples, three at least, as the path's own spacing makes of it.

    A frame of rows has a fixed width, so samples are numbered in units of their path's own width: n samples are SCALE units,
    and the frame is a range of these. It holds n // 2 samples before each and the rest from there on.
    """
    many = F.greatest(F.floor(F.lit(window_m) / F.col(spacing) + 1e-9), F.lit(3)).cast("long")
    at = points.withColumn("_w", many).withColumn("_u", F.expr(f"(cast(`{order}` as bigint) * {SCALE}L) div _w"))
    slack = 4  # units by which rounding may move a sample; a sample's own width is far more
    w = Window.partitionBy(key).orderBy("_u").rangeBetween(-(SCALE // 2) - slack, SCALE // 2 - slack)
    return at.withColumns({"rms": F.sqrt(F.avg(F.col(value) * F.col(value)).over(w)), "sd": F.stddev_samp(value).over(w)}).drop("_w", "_u")


def tangent_grade(points: DataFrame, key: str, order: str, z: str, spacing: str, window_m: float) -> DataFrame:
    """points with grade: slope, in per cent, of the line through the samples from window_m before to just under window_m after.

    Samples are `spacing` (a column, of each path) metres apart, so the frame is a range of metres, not of rows: each path
    has the width that its own spacing gives. A frame is closed at both ends; its last sample is taken off again where it
    lies a whole window ahead. 0 where fewer than three are left.
    """
    half = F.floor(F.lit(window_m) / F.col(spacing) + 1e-9)
    at = points.withColumn("_x", F.col(order) * F.col(spacing)).withColumn("_half", half)
    at = at.withColumn("_um", F.round(F.col("_x") * 1e6).cast("long"))  # a range of whole micrometres
    w = Window.partitionBy(key).orderBy("_um").rangeBetween(-int(window_m * 1e6) - 1, int(window_m * 1e6) + 1)
    u, v = F.col("_x") - F.col("_x0"), F.col(z) - F.col("_z0")
    whole = Window.partitionBy(key)
    at = at.withColumns({"_x0": F.avg("_x").over(whole), "_z0": F.avg(z).over(whole)}).withColumns({"_u": u, "_v": v})
    last = F.last(F.struct(F.col(order).alias("i"), "_u", "_v")).over(w)
    sums = {"_n": F.count("*").over(w), "_su": F.sum("_u").over(w), "_sv": F.sum("_v").over(w), "_suu": F.sum(F.col("_u") * F.col("_u")).over(w), "_suv": F.sum(F.col("_u") * F.col("_v")).over(w), "_last": last}
    s = at.withColumns(sums)
    off = (F.col("_last.i") - F.col(order) >= F.col("_half")).cast("double")
    lu, lv = F.col("_last._u"), F.col("_last._v")
    n, su, sv, suu, suv = F.col("_n") - off, F.col("_su") - off * lu, F.col("_sv") - off * lv, F.col("_suu") - off * lu * lu, F.col("_suv") - off * lu * lv
    slope = (n * suv - su * sv) / F.nullif(n * suu - su * su, F.lit(0.0)) * 100
    return s.withColumn("grade", F.when(n < 3, 0.0).otherwise(F.coalesce(slope, F.lit(0.0)))).select(*points.columns, "grade")


def quadratic_fit(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares parabola of each group in closed form, x being centred first: c0, c1, c2; three different x at least."""
    m = points.groupBy(*keys).agg(F.avg(x).alias("_m"))
    u = points.join(m, keys).withColumn("_u", F.col(x) - F.col("_m"))
    s = u.groupBy(*keys).agg(F.count("*").alias("n"), F.first("_m").alias("m"), *[F.sum(F.pow("_u", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)], *[F.sum(F.col(y) * F.pow("_u", F.lit(k))).alias(f"t{k}") for k in (0, 1, 2)])
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    a0 = (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det
    a1 = (n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - t1 * s2)) / det
    a2 = (n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det
    return s.where(F.abs(det) > 1e-9).select(*keys, F.round(a0 + 1e-9, 4).alias("c0"), F.round(a1 + 1e-9, 4).alias("c1"), F.round(a2 + 1e-9, 4).alias("c2"), "m")


def dip_candidates(profile: DataFrame, trend: str, z: str, dip: float, anchor: float, key: str = "route_id", order: str = "idx") -> DataFrame:
    """Runs of samples that lie `dip` below the trend, with the anchors on either side where the profile meets it again."""
    w = Window.partitionBy(key).orderBy(order)
    low = F.col(z) - F.col(trend) < -dip
    ok = F.when(F.col(z) >= F.col(trend) - anchor, F.col(order))
    a = profile.withColumn("_low", low).withColumn("_before", F.last(ok, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first(ok, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    a = a.withColumn("_run", islands(~F.col("_low"), w)).where("_low")
    return a.groupBy(key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min("_before").alias("anchor_before"), F.max("_after").alias("anchor_after"), F.round(F.min(F.col(z) - F.col(trend)), 6).alias("depth")).drop("_run")
