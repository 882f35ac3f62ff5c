"""Curves: runs of curvature, spirals, merged groups, parabolas."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..config import FEET_PER_METER, METERS_PER_MILE, Params
from ..functions.classify import superelevation
from ..operators import curves as C
from ..registry import query
from .joins import _BIN
from .sequence import _HEAD, _KAPPA

#: The samples stand for metres here: low thresholds give the synthetic paths curves.
_P = Params(h_max_radius_ft=400.0, h_min_length_ft=15.0, h_min_delta=3.5)
_THR = f"{1 / _P.metres('h_max_radius_ft')!r}::DOUBLE"


def _paths(spark, d):
    p = V.profile(spark, d).select("route_id", "idx", (F.col("idx") * 5.0).alias("x"), (F.col("z") / 20).alias("y"))
    return C.headings(C.curvature(p))


_SMALL = _KAPPA.replace("z AS y FROM profile", "z / 20 AS y FROM profile")
_HC = f"""+{_SMALL}, {_HEAD.replace('FROM xy', 'FROM k')}, o AS (SELECT k.route_id, k.idx, kappa, CASE WHEN turn > 0 THEN 1 WHEN turn < 0 THEN -1 END AS s, heading, sum((kappa < {_THR})::INT) OVER (PARTITION BY k.route_id ORDER BY k.idx) AS gap FROM k JOIN hd ON hd.route_id = k.route_id AND hd.idx = k.idx),
    l AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY route_id, gap ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o WHERE kappa >= {_THR}),
    r AS (SELECT *, sum((coalesce(before <> s, false))::INT) OVER (PARTITION BY route_id, gap ORDER BY idx) AS run FROM l), q AS (SELECT *, max(kappa) OVER (PARTITION BY route_id, gap, run) AS peak FROM r),
    g AS (SELECT route_id, min(idx) FILTER (kappa >= {_THR} * 1.05) AS a, max(idx) FILTER (kappa >= {_THR} * 1.05) AS b, arg_min(heading, idx) FILTER (kappa >= {_THR} * 1.05) AS ha, arg_max(heading, idx) FILTER (kappa >= {_THR} * 1.05) AS hb, max(kappa) AS peak, min(idx) FILTER (kappa >= 0.85 * peak) AS sc, max(idx) FILTER (kappa >= 0.85 * peak) AS cs, arg_min(s, idx) FILTER (s IS NOT NULL) AS side FROM q GROUP BY route_id, gap, run),
    h AS (SELECT route_id, a * 5.0::DOUBLE AS start_dist, b * 5.0::DOUBLE AS end_dist, greatest(sc, a) * 5.0::DOUBLE AS sc_dist, least(cs, b) * 5.0::DOUBLE AS cs_dist, (b - a) * 5.0::DOUBLE AS length_m, 1 / peak AS radius_m, 1 / peak AS min_radius_m, abs(hb - ha) AS delta, CASE WHEN side > 0 THEN 'Right' ELSE 'Left' END AS dir FROM g WHERE a IS NOT NULL)"""
_KEEP = f"WHERE end_dist > start_dist AND length_m >= {_P.metres('h_min_length_ft')!r} AND delta >= 3.5 AND min_radius_m <= {_P.metres('h_max_radius_ft')!r}"


@query(V.sql(f"""{_HC}
    SELECT route_id, start_dist, end_dist, round(radius_m, 4) AS radius_m, round(min_radius_m, 4) AS min_radius_m, round(delta, 4) AS delta, dir, CASE WHEN sc_dist - start_dist > {150 / FEET_PER_METER} OR end_dist - cs_dist > {150 / FEET_PER_METER} THEN 'Spiral' ELSE 'Simple' END AS transition, {_BIN.replace('radius_m', 'min_radius_m')} AS bin
    FROM h {_KEEP}""", "profile"))
def horizontal_curves(spark, d):
    c = C.horizontal_curves(_paths(spark, d), _P)
    return c.select("route_id", "start_dist", "end_dist", F.round("radius_m", 4).alias("radius_m"), F.round("min_radius_m", 4).alias("min_radius_m"), F.round("delta", 4).alias("delta"), "dir", "transition", "bin")


@query(V.sql("SELECT curve_id, CASE WHEN radius_m * 3.28084 < 1500 THEN 8.0::DOUBLE WHEN radius_m * 3.28084 < 3000 THEN 6.0::DOUBLE WHEN radius_m * 3.28084 < 6000 THEN 4.0::DOUBLE WHEN radius_m * 3.28084 < 99999 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS banking FROM curves", "curves"))
def superelevation_steps(spark, d):
    return V.curves(spark, d).select("curve_id", superelevation(F.col("radius_m")).alias("banking"))


@query(V.sql(f"""+w AS (SELECT *, coalesce(lag(dir) OVER o <> dir OR (c_start - lag(c_end) OVER o) * 5280 >= 600, true) AS new FROM curves WINDOW o AS (PARTITION BY route_id ORDER BY c_start, curve_id)),
    g AS (SELECT *, sum(new::INT) OVER (PARTITION BY route_id ORDER BY c_start, curve_id)::BIGINT AS grp FROM w),
    l AS (SELECT route_id, grp, count(*) AS n, list({{'s': c_start, 'e': c_end, 'r': radius_m, 'l': length_m}} ORDER BY c_start, curve_id) AS each, any_value(dir) AS dir, round(sum(delta), 4) AS delta, round(min(radius_m), 6) AS min_radius_m, bool_or(transition = 'Spiral') AS spiral FROM g GROUP BY 1, 2),
    m AS (SELECT *, list_reduce(each, lambda a, c: {{'s': a.s, 'e': c.e, 'r': (a.r * greatest((c.e - a.s) * {METERS_PER_MILE}, 1e-6) + c.r * greatest(c.l, 1e-6)) / (greatest((c.e - a.s) * {METERS_PER_MILE}, 1e-6) + greatest(c.l, 1e-6)), 'l': a.l}}) AS x FROM l)
    SELECT route_id, grp, n, each[1].s AS c_start, each[-1].e AS c_end, dir, delta, min_radius_m, round(x.r + 1e-9, 4) AS radius_m, CASE WHEN n > 1 THEN 'Compound' ELSE 'Simple' END AS merge_status, CASE WHEN spiral THEN 'Spiral' ELSE 'Simple' END AS transition,
    CASE WHEN x.r * 3.28084 < 1500 THEN 8.0::DOUBLE WHEN x.r * 3.28084 < 3000 THEN 6.0::DOUBLE WHEN x.r * 3.28084 < 6000 THEN 4.0::DOUBLE WHEN x.r * 3.28084 < 99999 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS banking, {_BIN.replace('radius_m', 'min_radius_m')} AS bin FROM m""", "curves"))  # fmt: skip
def compound_groups(spark, d):
    return C.compound_groups(V.curves(spark, d), 600.0)


@query(V.sql("""+p AS (SELECT route_id, idx // 20 AS part, idx::DOUBLE AS x, z FROM profile), c AS (SELECT route_id, part, avg(x) AS m FROM p GROUP BY 1, 2), u AS (SELECT p.*, x - m AS u, m FROM p JOIN c USING (route_id, part)),
    s AS (SELECT route_id, part, count(*) AS n, any_value(m) AS m, sum(u) AS s1, sum(u ** 2) AS s2, sum(u ** 3) AS s3, sum(u ** 4) AS s4, sum(z) AS t0, sum(z * u) AS t1, sum(z * u ** 2) AS t2 FROM u GROUP BY 1, 2),
    k AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM s)
    SELECT route_id, part, m, round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det + 1e-9, 4) AS c0, round((n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - t1 * s2)) / det + 1e-9, 4) AS c1, round((n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det + 1e-9, 4) AS c2
    FROM k WHERE abs(det) > 1e-9""", "profile"))  # fmt: skip
def quadratic_fit(spark, d):
    p = V.profile(spark, d).select("route_id", F.floor(F.col("idx") / 20).alias("part"), F.col("idx").cast("double").alias("x"), "z")
    return C.quadratic_fit(p, ["route_id", "part"], "x", "z")


@query(V.sql(f"""{_HC}, hc AS (SELECT route_id, start_dist, end_dist FROM h {_KEEP}), pt AS (SELECT hc.route_id, start_dist, end_dist, idx, x, y FROM hc JOIN k ON k.route_id = hc.route_id AND k.idx BETWEEN (start_dist / 5)::BIGINT AND (end_dist / 5)::BIGINT)
    SELECT route_id, start_dist, end_dist, count(*)::INT AS n, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y, round(arg_min(y, idx), 6) AS first_y, round(arg_max(y, idx), 6) AS last_y FROM pt GROUP BY 1, 2, 3""", "profile"))  # fmt: skip
def curve_slices(spark, d):
    p = _paths(spark, d)
    c = C.sliced(C.horizontal_curves(p, _P), p, "route_id", "start_dist", "end_dist", "idx", 5.0)
    total = lambda n: F.round(F.aggregate("points", F.lit(0.0), lambda a, q: a + q[n]), 4).alias(f"sum_{n}")
    return c.select("route_id", "start_dist", "end_dist", F.size("points").alias("n"), total("x"), total("y"), F.round(F.col("points")[0]["y"], 6).alias("first_y"), F.round(F.element_at("points", -1)["y"], 6).alias("last_y"))
