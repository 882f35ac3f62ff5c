"""Derivatives, trends, gaps, sight distance and mileposts along ordered samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..config import SIGHT_EYE_FT, SIGHT_OBJECT_FT, SIGHT_SEARCH_FT
from ..functions import sequence as Q
from ..operators import curves as C
from ..registry import query


def _order():
    """Samples of a route in order."""
    return Window.partitionBy("route_id").orderBy("idx")


_w = "(PARTITION BY route_id ORDER BY idx)"


def _grad(e: str, h: str = "5") -> str:
    return f"CASE WHEN lag(1) OVER w IS NULL THEN (lead({e}) OVER w - {e}) / {h} WHEN lead(1) OVER w IS NULL THEN ({e} - lag({e}) OVER w) / {h} ELSE (lead({e}) OVER w - lag({e}) OVER w) / (2 * {h}) END"


@query(V.sql(f"SELECT route_id, idx, round({_grad('z')}, 6) AS grade FROM profile WINDOW w AS {_w}", "profile"))
def gradient(spark, d):
    return V.profile(spark, d).select("route_id", "idx", F.round(Q.gradient(F.col("z"), _order(), 5.0), 6).alias("grade"))


_XY = "xy AS (SELECT route_id, idx, idx * 5.0::DOUBLE AS x, z AS y FROM profile)"
_KAPPA = f"""{_XY}, d1 AS (SELECT *, {_grad('x')} AS x1, {_grad('y')} AS y1 FROM xy WINDOW w AS {_w}), d2 AS (SELECT *, {_grad('x1')} AS x2, {_grad('y1')} AS y2 FROM d1 WINDOW w AS {_w}),
    k AS (SELECT route_id, idx, x, y, CASE WHEN pow(x1 * x1 + y1 * y1, 1.5) > 1e-12 THEN abs(x1 * y2 - y1 * x2) / pow(x1 * x1 + y1 * y1, 1.5) ELSE 0 END AS kappa, CASE WHEN pow(x1 * x1 + y1 * y1, 1.5) > 1e-12 THEN x1 * y2 - y1 * x2 ELSE 0 END AS turn FROM d2)"""


def _xy(spark, d):
    return V.profile(spark, d).select("route_id", "idx", (F.col("idx") * 5.0).alias("x"), F.col("z").alias("y"))


@query(V.sql(f"+{_KAPPA} SELECT route_id, idx, round(kappa, 6) AS kappa, round(turn, 6) AS turn FROM k", "profile"))
def curvature(spark, d):
    return C.curvature(_xy(spark, d)).select("route_id", "idx", F.round("kappa", 6).alias("kappa"), F.round("turn", 6).alias("turn"))


# A spiral path, so that headings pass whole turns.
_SPIRAL = "xy AS (SELECT route_id, idx, idx * cos(idx * 1.1) AS x, idx * sin(idx * 1.1) AS y FROM profile)"
_HEAD = """h0 AS (SELECT *, degrees(atan2(lead(y) OVER w - y, lead(x) OVER w - x)) AS e FROM xy WINDOW w AS (PARTITION BY route_id ORDER BY idx)),
    h1 AS (SELECT * EXCLUDE (e), coalesce(e, lag(e) OVER w) AS e FROM h0 WINDOW w AS (PARTITION BY route_id ORDER BY idx)), h2 AS (SELECT *, e - lag(e) OVER w AS s FROM h1 WINDOW w AS (PARTITION BY route_id ORDER BY idx)),
    h3 AS (SELECT *, ((s + 180) % 360 + 360) % 360 - 180 AS m FROM h2), h4 AS (SELECT *, CASE WHEN abs(s) < 180 THEN 0 ELSE (CASE WHEN m = -180 AND s > 0 THEN 180 ELSE m END) - s END AS c FROM h3),
    hd AS (SELECT route_id, idx, x, y, e + sum(coalesce(c, 0)) OVER (PARTITION BY route_id ORDER BY idx) AS heading FROM h4)"""


@query(V.sql(f"+{_SPIRAL}, {_HEAD} SELECT route_id, idx, round(heading, 4) AS heading FROM hd", "profile"))
def heading_unwrapped(spark, d):
    i = F.col("idx")
    p = V.profile(spark, d).select("route_id", "idx", (i * F.cos(i * 1.1)).alias("x"), (i * F.sin(i * 1.1)).alias("y"))
    return C.headings(p).select("route_id", "idx", F.round("heading", 4).alias("heading"))


_SPACED = "p AS (SELECT route_id, idx, z / 50 AS z, 4.0::DOUBLE + (route_id % 3) * 0.75::DOUBLE AS spacing FROM profile)"


@query(V.sql(f"""+{_SPACED}, j AS (SELECT a.route_id, a.idx, b.idx * b.spacing AS x, b.z FROM p a JOIN p b ON b.route_id = a.route_id AND b.idx >= a.idx - floor(30.0::DOUBLE / a.spacing) AND b.idx < a.idx + floor(30.0::DOUBLE / a.spacing))
    SELECT route_id, idx, CASE WHEN count(*) < 3 THEN 0.0::DOUBLE ELSE round(regr_slope(z, x) * 100 + 1e-9, 4) END AS grade FROM j GROUP BY 1, 2""", "profile"))  # fmt: skip
def tangent_grade(spark, d):
    p = V.profile(spark, d).select("route_id", "idx", (F.col("z") / 50).alias("z"), (F.lit(4.0) + (F.col("route_id") % 3) * 0.75).alias("spacing"))
    return C.tangent_grade(p, "route_id", "idx", "z", "spacing", 30.0).select("route_id", "idx", F.when(F.col("grade") != 0, F.round(F.col("grade") + 1e-9, 4)).otherwise(0.0).alias("grade"))


@query(V.sql("SELECT route_id, idx, round(quantile_cont(z, 0.5) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS trend FROM profile", "profile"))
def trend_median(spark, d):
    return V.profile(spark, d).select("route_id", "idx", F.round(F.percentile("z", F.lit(0.5)).over(_order().rowsBetween(-10, 10)), 6).alias("trend"))


@query(V.sql("""+h AS (SELECT route_id, idx, CASE WHEN NOT hole THEN z END AS z FROM profile), g AS (SELECT *, last_value(CASE WHEN z IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i0, first_value(CASE WHEN z IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS i1, last_value(z IGNORE NULLS) OVER b AS z0, first_value(z IGNORE NULLS) OVER a AS z1
    FROM h WINDOW b AS (PARTITION BY route_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY route_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT route_id, idx, round(CASE WHEN z IS NOT NULL THEN z WHEN z0 IS NULL THEN z1 WHEN z1 IS NULL THEN z0 ELSE z0 + (z1 - z0) * (idx - i0) / (i1 - i0) END, 6) AS z FROM g""", "profile"))  # fmt: skip
def nan_interpolate(spark, d):
    p = V.profile(spark, d).withColumn("z", F.when(~F.col("hole"), F.col("z")))
    return p.select("route_id", "idx", F.round(Q.interpolated(F.col("z"), F.col("idx"), ["route_id"], "idx"), 6).alias("z"))


@query(V.sql(f"+{_SPACED}, n AS (SELECT *, greatest(floor(30.0::DOUBLE / spacing), 3)::INT AS n FROM p) SELECT route_id, idx, round(sqrt(avg(z * z) OVER w), 6) AS rms, round(stddev_samp(z) OVER w, 6) AS sd FROM n WINDOW w AS (PARTITION BY route_id ORDER BY idx ROWS BETWEEN (n // 2) PRECEDING AND (n - n // 2 - 1) FOLLOWING)", "profile"))
def rolling_rms(spark, d):
    p = V.profile(spark, d).select("route_id", "idx", (F.col("z") / 50).alias("z"), (F.lit(4.0) + (F.col("route_id") % 3) * 0.75).alias("spacing"))
    r = C.rolling(p, "route_id", "idx", "z", "spacing", 30.0)
    return r.select("route_id", "idx", F.round("rms", 6).alias("rms"), F.round("sd", 6).alias("sd"))


#: Samples ahead that lie within the search distance, at 50 feet from one to the next.
_AHEAD = int(SIGHT_SEARCH_FT / 50)
SIGHT = f"""t AS (SELECT a.route_id, a.idx AS i, b.idx AS j, (b.idx - a.idx) * 50.0::DOUBLE AS dist, (b.z + {SIGHT_OBJECT_FT} - a.z - {SIGHT_EYE_FT}) / ((b.idx - a.idx) * 50.0::DOUBLE) AS target, (b.z - a.z - {SIGHT_EYE_FT}) / ((b.idx - a.idx) * 50.0::DOUBLE) AS ground FROM profile a JOIN profile b ON a.route_id = b.route_id AND b.idx BETWEEN a.idx + 1 AND a.idx + {_AHEAD}),
    s AS (SELECT *, max(ground) OVER (PARTITION BY route_id, i ORDER BY j) AS top FROM t), sight AS (SELECT p.route_id, idx, coalesce(max(dist) FILTER (target >= top), 0.0::DOUBLE) AS asd_ft FROM profile p LEFT JOIN s ON s.route_id = p.route_id AND i = idx GROUP BY 1, 2)"""


def sight(spark, d):
    """Available sight distance of every sample."""
    return C.sight_distance(V.profile(spark, d), 50.0).select("route_id", "idx", "asd_ft")


@query(V.sql(f"+{SIGHT} SELECT * FROM sight", "profile"))
def sight_distance(spark, d):
    return sight(spark, d)


_PATH = "p AS (SELECT route_id, idx, idx // 40 AS part, idx * 5.0::DOUBLE AS x, z / 20 AS y, 2.0::DOUBLE AS start_mp, 12.0::DOUBLE AS end_mp FROM profile)"


@query(V.sql(f"""+{_PATH}, s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM p WINDOW w AS (PARTITION BY route_id, part ORDER BY idx)),
    c AS (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY idx) AS dist, sum(step) OVER (PARTITION BY route_id) AS total FROM s) SELECT route_id, idx, round(dist, 4) AS dist_m, round(start_mp + dist / greatest(total, 1e-9) * (end_mp - start_mp), 6) AS milepost FROM c""", "profile"))  # fmt: skip
def cumulative_mileposts(spark, d):
    i = F.col("idx")
    p = V.profile(spark, d).select("route_id", "idx", F.floor(i / 40).alias("part"), (i * 5.0).alias("x"), (F.col("z") / 20).alias("y"), F.lit(2.0).alias("start_mp"), F.lit(12.0).alias("end_mp"))
    m = C.mileposts(p, "route_id", "part", "idx")
    return m.select("route_id", "idx", F.round("dist_m", 4).alias("dist_m"), F.round("milepost", 6).alias("milepost"))


@query(V.sql("SELECT route_id, idx, round(coalesce(sum(sqrt(25 + pow(z - zp, 2))) OVER (PARTITION BY route_id ORDER BY idx), 0) / max(t) OVER (PARTITION BY route_id), 6) AS m FROM (SELECT *, sum(sqrt(25 + pow(z - zp, 2))) OVER (PARTITION BY route_id) AS t FROM (SELECT route_id, idx, coalesce(z, 0) AS z, lag(coalesce(z, 0)) OVER (PARTITION BY route_id ORDER BY idx) AS zp FROM profile))", "profile"))
def fallback_m_values(spark, d):
    p = V.profile(spark, d).withColumn("z", F.coalesce("z", F.lit(0.0)))
    step = p.withColumn("s", F.sqrt(F.lit(25.0) + F.pow(F.col("z") - F.lag("z").over(_order()), 2)))
    m = F.coalesce(F.sum("s").over(_order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) / F.sum("s").over(Window.partitionBy("route_id"))
    return step.select("route_id", "idx", F.round(m, 6).alias("m"))


@query(V.sql("""+v AS (SELECT route_id, l_linenumber AS part, start_mp AS milepost, lag(start_mp) OVER (PARTITION BY route_id, l_linenumber ORDER BY l_orderkey, l_partkey) AS before FROM sections)
    SELECT route_id, part, count(*) AS n, count(*) FILTER (milepost < before) AS backward, count(*) FILTER (milepost < before) = 0 AS monotone FROM v GROUP BY 1, 2""", "sections"))  # fmt: skip
def milepost_continuity(spark, d):
    s = V.sections(spark, d).select("route_id", F.col("l_linenumber").alias("part"), "l_orderkey", "l_partkey", F.col("start_mp").alias("milepost"))
    back = F.col("milepost") < F.lag("milepost").over(Window.partitionBy("route_id", "part").orderBy("l_orderkey", "l_partkey"))
    return s.withColumn("back", back).groupBy("route_id", "part").agg(F.count("*").alias("n"), F.count_if("back").alias("backward"), (F.count_if("back") == 0).alias("monotone"))


@query(V.sql(f"+{_SPIRAL}, {_HEAD} SELECT route_id, idx, round(heading - lag(heading) OVER (PARTITION BY route_id ORDER BY idx), 4) AS change FROM hd", "profile"))
def heading_change(spark, d):
    i = F.col("idx")
    p = V.profile(spark, d).select("route_id", "idx", (i * F.cos(i * 1.1)).alias("x"), (i * F.sin(i * 1.1)).alias("y"))
    h = C.headings(p)
    return h.select("route_id", "idx", F.round(F.col("heading") - F.lag("heading").over(_order()), 4).alias("change"))


_TREND = "t AS (SELECT route_id, idx, z, quantile_cont(z, 0.5) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS trend FROM profile)"


@query(V.sql(f"""+{_TREND}, a AS (SELECT *, z - trend < -15 AS low, last_value(CASE WHEN z >= trend - 0.15 THEN idx END IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(CASE WHEN z >= trend - 0.15 THEN idx END IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM t),
    r AS (SELECT *, sum((NOT low)::INT) OVER (PARTITION BY route_id ORDER BY idx) AS run FROM a) SELECT route_id, min(idx) AS first, max(idx) AS last, min(b) AS anchor_before, max(f) AS anchor_after, round(min(z - trend), 6) AS depth FROM r WHERE low GROUP BY route_id, run""", "profile"))  # fmt: skip
def dip_candidates(spark, d):
    p = V.profile(spark, d).withColumn("trend", F.percentile("z", F.lit(0.5)).over(_order().rowsBetween(-10, 10)))
    return C.dip_candidates(p, "trend", "z", 15.0, 0.15)
