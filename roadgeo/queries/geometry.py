"""Geometry and geodesy of points, lines and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import geo as G
from ..operators import spatial
from ..registry import query

_PTS = "p AS (SELECT c_custkey, (c_custkey * 37 % 35900) / 100.0::DOUBLE - 179.5::DOUBLE AS lon, (c_custkey * 91 % 15900) / 100.0::DOUBLE - 79.5::DOUBLE AS lat FROM customer)"


def _pts(spark, d):
    k = F.col("c_custkey")
    return V.table(spark, d, "customer").select("c_custkey", (k * 37 % 35900 / 100.0 - 179.5).alias("lon"), (k * 91 % 15900 / 100.0 - 79.5).alias("lat"))


_ZONE = "(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1)::INT"


@query(f"WITH {_PTS} SELECT c_custkey, {_ZONE} AS epsg FROM p")
def utm_zone(spark, d):
    return _pts(spark, d).select("c_custkey", G.utm_zone(F.col("lon"), F.col("lat")).alias("epsg"))


_EN = G.utm_sql("lon", "lat", "epsg")


@query(f"WITH {_PTS}, z AS (SELECT *, {_ZONE} AS epsg FROM p) SELECT c_custkey, round({_EN[0]}, 3) AS easting, round({_EN[1]}, 3) AS northing FROM z")
def utm_forward(spark, d):
    p = _pts(spark, d).withColumn("epsg", G.utm_zone(F.col("lon"), F.col("lat")))
    e, n = G.utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    return p.select("c_custkey", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


_LL = G.utm_inverse_sql("easting", "northing", "epsg")


@query(f"WITH {_PTS}, z AS (SELECT *, {_ZONE} AS epsg FROM p), u AS (SELECT c_custkey, epsg, round({_EN[0]}, 3) AS easting, round({_EN[1]}, 3) AS northing FROM z) SELECT c_custkey, round({_LL[0]}, 6) AS lon, round({_LL[1]}, 6) AS lat FROM u")
def utm_inverse(spark, d):
    p = _pts(spark, d).withColumn("epsg", G.utm_zone(F.col("lon"), F.col("lat")))
    e, n = G.utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    lon, lat = G.utm_inverse(F.col("e"), F.col("n"), F.col("epsg"))
    return p.select("c_custkey", "epsg", F.round(e, 3).alias("e"), F.round(n, 3).alias("n")).select("c_custkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"WITH {_PTS} SELECT c_custkey, printf('%s%02d%s%03d', CASE WHEN lat >= 0 THEN 'n' ELSE 's' END, ceil(abs(lat))::INT, CASE WHEN lon < 0 THEN 'w' ELSE 'e' END, ceil(abs(lon))::INT) AS tile FROM p")
def dem_tile_name(spark, d):
    return _pts(spark, d).select("c_custkey", G.tile_name(F.col("lon"), F.col("lat")).alias("tile"))


@query(f"""WITH {_PTS}, b AS (SELECT c_custkey % 30 AS grp, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM p GROUP BY 1),
    x AS (SELECT *, unnest(range(floor(x0)::BIGINT, ceil(x1)::BIGINT + 1)) AS tx FROM b) SELECT grp, tx, unnest(range(floor(y0)::BIGINT, ceil(y1)::BIGINT + 1)) AS ty FROM x""")  # fmt: skip
def tiles_for_bbox(spark, d):
    b = _pts(spark, d).groupBy((F.col("c_custkey") % 30).alias("grp")).agg(*[f(c).alias(n) for f, c, n in ((F.min, "lon", "x0"), (F.max, "lon", "x1"), (F.min, "lat", "y0"), (F.max, "lat", "y1"))])
    return b.withColumn("tx", F.explode(F.sequence(F.floor("x0"), F.ceil("x1")))).select("grp", "tx", F.explode(F.sequence(F.floor("y0"), F.ceil("y1"))).alias("ty"))


@query(f"WITH {_PTS} SELECT c_custkey, round(2 * 3958.8::DOUBLE * 5280 * asin(least(1.0, sqrt(pow(sin(radians(45.0::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(45.0::DOUBLE)) * pow(sin(radians(-120.0::DOUBLE - lon) / 2), 2)))), 3) AS feet FROM p")
def haversine_ft(spark, d):
    return _pts(spark, d).select("c_custkey", F.round(G.haversine_ft(F.col("lon"), F.col("lat"), F.lit(-120.0), F.lit(45.0)), 3).alias("feet"))


_LINE = "l AS (SELECT vec_id, list_transform(range(0, 32), lambda i: {'x': embedding[2 * i + 1]::DOUBLE, 'y': embedding[2 * i + 2]::DOUBLE}) AS pts FROM embeddings)"


def _lines(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("v", 2 * i).alias("x"), F.get("v", 2 * i + 1).alias("y"))).alias("pts"))


@query(f"WITH {_LINE}, u AS (SELECT vec_id, unnest(pts) AS p, unnest(range(0, 32)) AS i FROM l), s AS (SELECT vec_id, round(p.x, 4) AS x, round(p.y, 4) AS y, i FROM u), t AS (SELECT vec_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, 32::INT AS n, round(sum(d), 4) AS length FROM t GROUP BY 1")
def wkt_parse_length(spark, d):
    text = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("pts", lambda p: F.format_string("%.4f %.4f", p["x"], p["y"])), ", "), F.lit(")"))
    w = _lines(spark, d).select("vec_id", G.wkt_points(text)[0].alias("p"))
    return w.select("vec_id", F.size("p").alias("n"), F.round(G.path_length(F.col("p")), 4).alias("length"))


@query(f"WITH {_LINE} SELECT vec_id, 'LINESTRING ZM (' || array_to_string(list_transform(pts, lambda p: printf('%.7f %.7f %.2f %.4f', p.x + 1e-9, p.y + 1e-9, p.x * 100 + 200 + 1e-9, p.y + 1 + 1e-9)), ', ') || ')' AS wkt FROM l")
def wkt_zm_build(spark, d):
    p = F.transform("pts", lambda p: F.struct((p["x"] + 1e-9).alias("x"), (p["y"] + 1e-9).alias("y"), (p["x"] * 100 + 200 + 1e-9).alias("z"), (p["y"] + 1 + 1e-9).alias("m")))
    return _lines(spark, d).select("vec_id", G.wkt_zm(p).alias("wkt"))


@query(f"WITH {_LINE} SELECT vec_id, round(CASE WHEN vec_id % 2 = 0 THEN pts[32].x ELSE pts[1].x END, 6) AS first_x, vec_id % 2 = 0 AS turned FROM l")
def reverse_by_mp(spark, d):
    turned = F.col("vec_id") % 2 == 0
    return _lines(spark, d).select("vec_id", F.round(F.when(turned, F.reverse("pts")).otherwise(F.col("pts"))[0]["x"], 6).alias("first_x"), turned.alias("turned"))


@query("SELECT o_orderkey, i, least((i + 1) * 1609.34::DOUBLE, o_totalprice / 10) - i * 1609.34::DOUBLE >= 1609 AS whole, round(i * 1609.34::DOUBLE, 4) AS from_m FROM (SELECT o_orderkey, o_totalprice, unnest(range(0, CASE WHEN o_totalprice / 10 < 1600 THEN 0 ELSE floor(o_totalprice / 10 / 1609.34)::BIGINT + CASE WHEN o_totalprice / 10 - floor(o_totalprice / 10 / 1609.34) * 1609.34 >= 800 THEN 1 ELSE 0 END END)) AS i FROM orders)")
def one_mile_chunks(spark, d):
    length = F.col("o_totalprice") / 10
    full = F.floor(length / 1609.34)
    n = F.when(length < 1600, 0).otherwise(full + F.when(length - full * 1609.34 >= 800, 1).otherwise(0))
    o = V.table(spark, d, "orders").where(n > 0).select("o_orderkey", length.alias("len"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return o.select("o_orderkey", "i", (F.least((F.col("i") + 1) * 1609.34, "len") - F.col("i") * 1609.34 >= 1609).alias("whole"), F.round(F.col("i") * 1609.34, 4).alias("from_m"))


@query(V.sql("""+p AS (SELECT route_id, idx, floor(idx * 50 / 1500.0::DOUBLE)::BIGINT AS page, idx * 50.0::DOUBLE AS x, z * 3 AS y, idx * 50 / 5280.0::DOUBLE AS mp FROM profile),
    c AS (SELECT route_id, page, arg_min(x, idx) AS x0, arg_min(y, idx) AS y0, atan2(arg_max(y, idx) - arg_min(y, idx), arg_max(x, idx) - arg_min(x, idx)) AS a, min(mp) AS m0, max(mp) AS m1, count(*) AS n FROM p GROUP BY 1, 2),
    r AS (SELECT route_id, page, idx, m0, m1, (x - x0) * cos(-a) - (y - y0) * sin(-a) AS x, (x - x0) * sin(-a) + (y - y0) * cos(-a) AS y FROM p JOIN c USING (route_id, page) WHERE n >= 2),
    e AS (SELECT route_id, page, min(x) AS x0, max(x) AS x1 FROM r GROUP BY 1, 2)
    SELECT route_id, page, idx, round(CASE WHEN x1 > x0 THEN m0 + (x - x0) * (m1 - m0) / (x1 - x0) ELSE x END, 4) AS x, round(y, 3) AS y FROM r JOIN e USING (route_id, page)""", "profile"))  # fmt: skip
def rotate_page(spark, d):
    p = V.profile(spark, d).select("route_id", "idx", F.floor(F.col("idx") * 50 / 1500.0).alias("page"), (F.col("idx") * 50.0).alias("x"), (F.col("z") * 3).alias("y"), (F.col("idx") * 50 / 5280.0).alias("mp"))
    r = spatial.pages(p, ["route_id", "page"], "idx")
    return r.select("route_id", "page", "idx", F.round("x", 4).alias("x"), F.round("y", 3).alias("y"))


_PIECES = f"{_LINE}, q AS (SELECT (vec_id % 20)::BIGINT AS route_id, vec_id * 4 + j AS seq, pts[8 * j + 1 : 8 * j + 9 - (vec_id + j) % 2] AS pts FROM (SELECT vec_id, pts, unnest(range(0, 4)) AS j FROM l))"


@query(f"""WITH {_PIECES}, w AS (SELECT *, coalesce(sqrt(pow(pts[1].x - lag(pts[-1].x) OVER o, 2) + pow(pts[1].y - lag(pts[-1].y) OVER o, 2)) >= 1e-6, true) AS new FROM q WINDOW o AS (PARTITION BY route_id ORDER BY seq)),
    c AS (SELECT *, sum(new::INT) OVER (PARTITION BY route_id ORDER BY seq) AS chain, CASE WHEN new THEN pts ELSE pts[2:] END AS own FROM w), g AS (SELECT route_id, chain, count(*) AS pieces, flatten(list(own ORDER BY seq)) AS p FROM c GROUP BY 1, 2)
    SELECT route_id, chain::BIGINT AS chain, pieces, len(p)::INT AS n, round(p[1].x, 6) AS x0, round(p[-1].y, 6) AS y1, round(list_sum(list_transform(p, lambda q: q.x)), 4) AS sum_x FROM g WHERE len(p) >= 2""")  # fmt: skip
def stitch_ordered(spark, d):
    j, v = F.col("j"), F.col("vec_id")
    own = F.slice("pts", 8 * j + 1, F.least(9 - (v + j) % 2, F.size("pts") - 8 * j).cast("int"))
    q = _lines(spark, d).withColumn("j", F.explode(F.array(*map(F.lit, range(4))))).select((v % 20).cast("long").alias("route_id"), (v * 4 + j).alias("seq"), own.alias("pts"))
    c = spatial.stitch_ordered(q, "route_id", "seq", "pts")
    return c.select("route_id", "chain", "pieces", F.size("points").alias("n"), F.round(F.col("points")[0]["x"], 6).alias("x0"), F.round(F.element_at("points", -1)["y"], 6).alias("y1"), F.round(F.aggregate("points", F.lit(0.0), lambda a, q: a + q["x"]), 4).alias("sum_x"))


@query(f"""WITH {_LINE}, u AS (SELECT vec_id, unnest(pts) AS p, unnest(range(0, 32)) AS i FROM l), s AS (SELECT vec_id, i, p.x AS x, p.y AS y, lead(p.x) OVER w AS x2, lead(p.y) OVER w AS y2 FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
    e AS (SELECT *, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS d FROM s WHERE x2 IS NOT NULL), c AS (SELECT *, sum(d) OVER (PARTITION BY vec_id ORDER BY i) - d AS before, sum(d) OVER (PARTITION BY vec_id) AS total FROM e),
    g AS (SELECT vec_id, total, unnest(range(0, 11)) AS k FROM (SELECT vec_id, max(total) AS total FROM c GROUP BY 1)), a AS (SELECT g.vec_id, k, arg_max(x + (x2 - x) * greatest(least((k * g.total / 10 - before) / d, 1), 0), i) AS x, arg_max(y + (y2 - y) * greatest(least((k * g.total / 10 - before) / d, 1), 0), i) AS y FROM g JOIN c ON c.vec_id = g.vec_id AND (before <= k * g.total / 10 OR i = 0) GROUP BY 1, 2)
    SELECT vec_id, k, round(x, 5) AS x, round(y, 5) AS y FROM a""")  # fmt: skip
def densify_grid(spark, d):
    n = 10
    p = _lines(spark, d)
    steps = F.transform(F.sequence(F.lit(0), F.size("pts") - 2), lambda i: F.sqrt(F.pow(F.get("pts", i + 1)["x"] - F.get("pts", i)["x"], 2) + F.pow(F.get("pts", i + 1)["y"] - F.get("pts", i)["y"], 2)))
    p = p.withColumn("d", steps).withColumn("before", F.transform("d", lambda _, i: F.aggregate(F.slice("d", 1, i), F.lit(0.0), lambda a, b: a + b))).withColumn("total", F.aggregate("d", F.lit(0.0), lambda a, b: a + b))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("at", F.col("k") * F.col("total") / n)
    edge = F.greatest(F.lit(1), F.size(F.filter("before", lambda b: b <= F.col("at")))) - 1
    p = p.withColumn("e", edge).withColumn("t", F.greatest(F.least((F.col("at") - F.get("before", F.col("e"))) / F.get("d", F.col("e")), F.lit(1.0)), F.lit(0.0)))
    a, b = F.get("pts", F.col("e")), F.get("pts", F.col("e") + 1)
    return p.select("vec_id", F.col("k").cast("long").alias("k"), *[F.round(a[c] + (b[c] - a[c]) * F.col("t"), 5).alias(c) for c in ("x", "y")])


@query(f"WITH {_PTS} SELECT c_custkey % 30 AS grp, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM p GROUP BY 1")
def total_bounds(spark, d):
    return _pts(spark, d).groupBy((F.col("c_custkey") % 30).alias("grp")).agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"))


@query("""WITH r AS (SELECT 46 + l_suppkey % 2 AS north, l_partkey % 24 AS row, l_linenumber AS col, min(CASE WHEN (l_suppkey + l_partkey) % 5 = 0 THEN -9999.0::DOUBLE ELSE l_tax * 1000 - 5 END) AS z FROM lineitem GROUP BY ALL)
    SELECT c_custkey, round(CASE WHEN z >= -1000 THEN z END, 4) AS z FROM customer LEFT JOIN r ON north = 46 + c_custkey % 3 AND row = c_custkey % 24 AND col = c_custkey % 7 + 1""")  # fmt: skip
def raster_sample(spark, d):
    # Points in the middle of cells of two tiles, and of one that the raster lacks; cells below the void mark are null.
    z = F.when((F.col("l_suppkey") + F.col("l_partkey")) % 5 == 0, -9999.0).otherwise(F.col("l_tax") * 1000 - 5)
    r = V.table(spark, d, "lineitem").groupBy(F.format_string("n%02dw121", (F.lit(46) + F.col("l_suppkey") % 2).cast("int")).alias("tile"), (F.col("l_partkey") % 24).alias("row"), F.col("l_linenumber").alias("col")).agg(F.min(z).alias("z"))
    k = F.col("c_custkey")
    p = V.table(spark, d, "customer").select("c_custkey", (F.lit(-121.0) + (k % 7 + 1.5) / 2400).alias("lon"), (F.lit(46.0) + k % 3 - (k % 24 + 0.5) / 2400).alias("lat"))
    return spatial.sampled(p, r, "lon", "lat", "z").select("c_custkey", F.round("z", 4).alias("z"))
