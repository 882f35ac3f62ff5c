"""Interval, spatial and key joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..config import CLEARANCE_RADIUS_DEG, TOPOLOGY_RADIUS_DEG
from ..functions.classify import degree_bin, degree_of_curve, topology
from ..operators import intervals, spatial
from ..registry import query

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_DEG = "1746.38::DOUBLE / radius_m"
_BIN = f"CASE WHEN {_DEG} < 3.5 THEN 'A' WHEN {_DEG} < 5.5 THEN 'B' WHEN {_DEG} < 8.5 THEN 'C' WHEN {_DEG} < 14 THEN 'D' WHEN {_DEG} < 28 THEN 'E' ELSE 'F' END"


def _binned(spark, d):
    return V.curves(spark, d).withColumn("bin", degree_bin(degree_of_curve(F.col("radius_m"))))


@query(V.sql(f"""SELECT s.route_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, start_mp, end_mp, coalesce(max(CASE WHEN curve_id IS NOT NULL THEN {_BIN} END), 'A') AS h_bin
    FROM sections s LEFT JOIN curves c ON s.route_id = c.route_id AND end_mp > c_start AND start_mp < c_end GROUP BY ALL""", "sections", "curves"))  # fmt: skip
def section_scores(spark, d):
    return intervals.worst_bin(V.sections(spark, d), _binned(spark, d), _KEY, "bin", "h_bin")


@query(V.sql(f"""+c AS (SELECT *, {_BIN} AS bin FROM curves),
    o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, bin, greatest(least(end_mp, c_end) - greatest(start_mp, c_start), 0) AS len FROM sections s JOIN c ON s.route_id = c.route_id AND end_mp > c_start AND start_mp < c_end WHERE bin <> 'A'),
    g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(f"coalesce(sum(len) FILTER (bin = '{x}'), 0.0::DOUBLE) AS {x.lower()}" for x in "BCDEF")} FROM o GROUP BY 1, 2, 3, 4)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(end_mp - start_mp - (coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0) + coalesce(e, 0) + coalesce(f, 0)), 0), 6) AS len_a,
    {', '.join(f"round(coalesce({x}, 0.0::DOUBLE), 6) AS len_{x}" for x in "bcdef")} FROM sections LEFT JOIN g USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)""", "sections", "curves"))  # fmt: skip
def curve_apportion(spark, d):
    return intervals.apportioned(V.sections(spark, d), _binned(spark, d), _KEY, "bin")


_POINTS = "p AS (SELECT CAST(user_id % 50 AS VARCHAR) AS route_id, event_id, (event_id % 2000)::DOUBLE AS mp FROM events)"


def _points(spark, d):
    e = V.table(spark, d, "events")
    return e.select((F.col("user_id") % 50).cast("string").alias("route_id"), "event_id", (F.col("event_id") % 2000).cast("double").alias("mp"))


@query(V.sql(f"""+{_POINTS} SELECT p.route_id, event_id, mp, arg_max(CASE WHEN merge_status = 'Compound' THEN 'Compound ' ELSE '' END || dir, curve_id) AS tag
    FROM p LEFT JOIN curves c ON p.route_id = c.route_id AND mp BETWEEN c_start AND c_end GROUP BY ALL""", "curves"))  # fmt: skip
def vertex_tagging(spark, d):
    c = V.curves(spark, d).withColumn("tag", F.concat(F.when(F.col("merge_status") == "Compound", "Compound ").otherwise(""), F.col("dir")))
    return intervals.point_in_interval(_points(spark, d), c, "mp", "c_start", "c_end", "curve_id", "tag", ["event_id"])


@query(V.sql(f"""+{_POINTS}, q AS (SELECT route_id, start_mp, end_mp, CASE WHEN l_linenumber = 3 THEN NULL ELSE iri END AS iri, ((l_orderkey * 10 + l_linenumber) * 10000 + l_partkey) * 1000 + l_quantity::BIGINT AS seq FROM sections JOIN lineitem USING (l_orderkey, l_linenumber, l_partkey, l_suppkey))
    SELECT p.route_id, event_id, mp, round(arg_max(iri, seq), 6) AS iri FROM p LEFT JOIN (SELECT route_id, start_mp, end_mp, max(seq) AS seq, arg_max(iri, seq) AS iri FROM q WHERE iri IS NOT NULL GROUP BY ALL) q ON p.route_id = q.route_id AND mp BETWEEN start_mp AND end_mp GROUP BY ALL""", "sections"))  # fmt: skip
def iri_mapping(spark, d):
    s = V.sections(spark, d)
    seq = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000 + F.col("l_partkey")) * 1000 + (F.col("end_mp") - F.col("start_mp")).cast("long")
    s = s.withColumn("seq", seq).withColumn("iri", F.when(F.col("l_linenumber") != 3, F.col("iri")))
    got = intervals.point_in_interval(_points(spark, d), s, "mp", "start_mp", "end_mp", "seq", "iri", ["event_id"], skip_null=True)
    return got.withColumn("iri", F.round("iri", 6))


def _dist(a: str, b: str) -> str:
    return f"sqrt(pow({a}.lon - {b}.lon, 2) + pow({a}.lat - {b}.lat, 2))"


@query(V.sql(f"SELECT node_id, route_id FROM nodes n WHERE EXISTS (SELECT 1 FROM structures s WHERE {_dist('n', 's')} <= 0.00004)", "nodes", "structures"))
def structure_radius_semi(spark, d):
    s = V.structures(spark, d).select(F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    return spatial.within(V.nodes(spark, d), s, "lon", "lat", "s_lon", "s_lat", 0.00004, "left_semi").select("node_id", "route_id")


@query(V.sql(f"""SELECT node_id, structure_id, round(d, 6) AS dist FROM (SELECT node_id, structure_id, round({_dist('n', 's')}, 9) AS d, row_number() OVER (PARTITION BY node_id ORDER BY round({_dist('n', 's')}, 9), structure_id) AS k
    FROM nodes n JOIN structures s ON {_dist('n', 's')} <= {CLEARANCE_RADIUS_DEG}) WHERE k = 1""", "nodes", "structures"))  # fmt: skip
def nearest_structure(spark, d):
    s = V.structures(spark, d).select("structure_id", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    return spatial.nearest(V.nodes(spark, d), s, "node_id", "structure_id", "lon", "lat", "s_lon", "s_lat", CLEARANCE_RADIUS_DEG)


@query(V.sql(f"""+{_POINTS}, t AS (SELECT p.*, EXISTS (SELECT 1 FROM sections s WHERE s.route_id = p.route_id AND structure_type IN (1, 2) AND start_mp < end_mp AND mp BETWEEN start_mp AND end_mp) AS one, -125.0::DOUBLE + (event_id % 60) / 100.0::DOUBLE + (event_id % 5) * 0.00001::DOUBLE AS lon, 25.0::DOUBLE + (event_id % 24) / 100.0::DOUBLE AS lat FROM p)
    SELECT route_id, event_id, mp, CASE WHEN one THEN 1 WHEN EXISTS (SELECT 1 FROM structures s WHERE sqrt(pow(t.lon - s.lon, 2) + pow(t.lat - s.lat, 2)) <= 0.00005) THEN 2 ELSE 0 END::INT AS tier FROM t""", "sections", "structures"))  # fmt: skip
def structure_mask(spark, d):
    e = F.col("event_id")
    p = _points(spark, d).withColumn("lon", F.lit(-125.0) + (e % 60) / 100.0 + (e % 5) * 0.00001).withColumn("lat", F.lit(25.0) + (e % 24) / 100.0)
    known = intervals.on_structures(p, V.sections(spark, d).select("route_id", "structure_type", "start_mp", "end_mp"), "mp", ["event_id", "lon", "lat"])
    s = V.structures(spark, d).select(F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    near = spatial.within(known.where("not on_structure"), s, "lon", "lat", "s_lon", "s_lat", 0.00005, "left_semi").select("event_id", F.lit(2).alias("near"))
    t = known.join(near, "event_id", "left")
    return t.select("route_id", "event_id", "mp", F.when(F.col("on_structure"), 1).otherwise(F.coalesce("near", F.lit(0))).cast("int").alias("tier"))


_PAIRS = f"pairs AS (SELECT a.node_id, b.node_id AS o_node_id, a.route_id, b.route_id AS o_route_id, abs(a.elev - b.elev) AS dz FROM nodes a JOIN nodes b ON a.node_id < b.node_id AND a.route_id <> b.route_id AND {_dist('a', 'b')} <= {TOPOLOGY_RADIUS_DEG})"


@query(V.sql(f"+{_PAIRS} SELECT node_id, o_node_id, route_id, o_route_id, round(dz, 4) AS dz, CASE WHEN dz > 10 THEN 'Grade-Separated' WHEN dz <= 5 THEN 'At-Grade' END AS node FROM pairs WHERE dz > 10 OR dz <= 5", "nodes"))
def topology_nodes(spark, d):
    p = spatial.topology_pairs(V.nodes(spark, d), TOPOLOGY_RADIUS_DEG).withColumn("node", topology(F.col("dz")))
    return p.where("node is not null").select("node_id", "o_node_id", "route_id", "o_route_id", F.round("dz", 4).alias("dz"), "node")


@query(V.sql(f"""+{_PAIRS} SELECT route_a, route_b, node_id, o_node_id, round(dz, 4) AS dz FROM (SELECT least(route_id, o_route_id) AS route_a, greatest(route_id, o_route_id) AS route_b, node_id, o_node_id, dz,
    row_number() OVER (PARTITION BY least(route_id, o_route_id), greatest(route_id, o_route_id) ORDER BY node_id, o_node_id) AS k FROM pairs) WHERE k = 1""", "nodes"))  # fmt: skip
def mirror_pairs(spark, d):
    p = spatial.first_pairs(V.nodes(spark, d), TOPOLOGY_RADIUS_DEG, False)
    return p.select(F.least("route_id", "o_route_id").alias("route_a"), F.greatest("route_id", "o_route_id").alias("route_b"), "node_id", "o_node_id", F.round("dz", 4).alias("dz"))


@query("""WITH s AS (SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1), r AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderstatus <> 'F')
    SELECT c_custkey, coalesce(n, 0) AS n, CASE WHEN n IS NOT NULL THEN 'smoothed' WHEN r.c_custkey IS NOT NULL THEN 'raw_fallback' END AS elevation_source FROM customer LEFT JOIN s USING (c_custkey) LEFT JOIN r USING (c_custkey)""")  # fmt: skip
def elevation_source(spark, d):
    c, o = V.table(spark, d, "customer").select("c_custkey"), V.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    smooth = o.where("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.count("*").alias("n"))
    raw = o.where("o_orderstatus <> 'F'").select("c_custkey").distinct().withColumn("raw", F.lit(True))
    j = c.join(smooth, "c_custkey", "left").join(raw, "c_custkey", "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNotNull(), "smoothed").when(F.col("raw"), "raw_fallback").alias("elevation_source"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def fallback_antijoin(spark, d):
    o = V.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return V.table(spark, d, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left_anti")


@query(V.sql("SELECT DISTINCT route_id, state FROM sections WHERE route_id IN (SELECT route_id FROM curves WHERE radius_m < 300)", "sections", "curves"))
def curve_route_semi(spark, d):
    c = V.curves(spark, d).where("radius_m < 300").select("route_id").distinct()
    return V.sections(spark, d).select("route_id", "state").distinct().join(c, "route_id", "left_semi")


@query("""WITH f AS (SELECT n_nationkey, n_regionkey * 100 + 200 AS factor FROM nation WHERE n_regionkey <> 3)
    SELECT s_suppkey, coalesce(factor, 1400) AS v_factor, factor IS NOT NULL AS own FROM supplier LEFT JOIN f ON s_nationkey = n_nationkey""")
def state_factor_lookup(spark, d):
    f = V.table(spark, d, "nation").where("n_regionkey <> 3").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_regionkey") * 100 + 200).alias("factor"))
    s = V.table(spark, d, "supplier").join(f, "s_nationkey", "left")
    return s.select("s_suppkey", F.coalesce("factor", F.lit(1400)).alias("v_factor"), F.col("factor").isNotNull().alias("own"))


@query(V.sql(f"""+{_POINTS}, v AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN '1_HPMS' WHEN event_id % 11 = 0 THEN '2_NBI' ELSE 'None' END AS tier FROM p)
    SELECT c.curve_id, c.route_id, coalesce(bool_or(tier IN ('1_HPMS', '2_NBI')), false) AS false_valley FROM curves c LEFT JOIN v ON v.route_id = c.route_id AND mp BETWEEN c_start AND c_end WHERE kind = 'SAG' GROUP BY 1, 2""", "curves"))  # fmt: skip
def false_valley(spark, d):
    tier = F.when(F.col("event_id") % 9 == 0, "1_HPMS").when(F.col("event_id") % 11 == 0, "2_NBI").otherwise("None")
    v = _points(spark, d).withColumn("tier", tier).withColumn("e", F.col("mp"))
    c = V.curves(spark, d).where("kind = 'SAG'").withColumn("_b", F.explode(F.sequence(F.floor(F.col("c_start") / 100), F.floor(F.col("c_end") / 100))))
    hit = c.join(v.withColumn("_b", F.floor(F.col("mp") / 100)), ["route_id", "_b"], "left")
    inside = (F.col("mp") >= F.col("c_start")) & (F.col("mp") <= F.col("c_end")) & F.col("tier").isin("1_HPMS", "2_NBI")
    return hit.groupBy("curve_id", "route_id").agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("false_valley"))


@query("""WITH s AS (SELECT c_custkey AS id, -120.0::DOUBLE + (c_custkey % 37) / 300.0::DOUBLE AS x0, 40.0::DOUBLE + (c_custkey % 23) / 300.0::DOUBLE AS y0, -120.0::DOUBLE + (c_custkey % 37) / 300.0::DOUBLE + (c_custkey % 11) / 200.0::DOUBLE AS x1, 40.0::DOUBLE + (c_custkey % 23) / 300.0::DOUBLE + (c_custkey % 5) / 100.0::DOUBLE AS y1 FROM customer),
    b AS (SELECT min(least(x0, x1)) AS mx, min(least(y0, y1)) AS my FROM s),
    g AS (SELECT s.*, mx, my, unnest(range(floor((least(x0, x1) - mx) / 0.02)::BIGINT, floor((greatest(x0, x1) - mx) / 0.02)::BIGINT + 1)) AS gx FROM s, b),
    h AS (SELECT *, unnest(range(floor((least(y0, y1) - my) / 0.02)::BIGINT, floor((greatest(y0, y1) - my) / 0.02)::BIGINT + 1)) AS gy FROM g),
    t AS (SELECT *, CASE WHEN x1 = x0 THEN 0 ELSE least((mx + gx * 0.02::DOUBLE - x0) / (x1 - x0), (mx + gx * 0.02::DOUBLE + 0.02::DOUBLE - x0) / (x1 - x0)) END AS ax, CASE WHEN x1 = x0 THEN 1 ELSE greatest((mx + gx * 0.02::DOUBLE - x0) / (x1 - x0), (mx + gx * 0.02::DOUBLE + 0.02::DOUBLE - x0) / (x1 - x0)) END AS bx,
        CASE WHEN y1 = y0 THEN 0 ELSE least((my + gy * 0.02::DOUBLE - y0) / (y1 - y0), (my + gy * 0.02::DOUBLE + 0.02::DOUBLE - y0) / (y1 - y0)) END AS ay, CASE WHEN y1 = y0 THEN 1 ELSE greatest((my + gy * 0.02::DOUBLE - y0) / (y1 - y0), (my + gy * 0.02::DOUBLE + 0.02::DOUBLE - y0) / (y1 - y0)) END AS b_y FROM h)
    SELECT id, gx, gy FROM t WHERE greatest(ax, ay, 0) <= least(bx, b_y, 1)""")  # fmt: skip
def grid_cell_assign(spark, d):
    k = F.col("c_custkey")
    x0, y0 = F.lit(-120.0) + (k % 37) / 300.0, F.lit(40.0) + (k % 23) / 300.0
    s = V.table(spark, d, "customer").select(k.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + (k % 11) / 200.0).alias("x1"), (y0 + (k % 5) / 100.0).alias("y1"))
    return spatial.cells_of_segments(s, "x0", "y0", "x1", "y1", 0.02).select("id", "gx", "gy")


@query(V.sql("SELECT route_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, start_mp FROM (SELECT *, lag(end_mp) OVER (PARTITION BY route_id ORDER BY start_mp, l_orderkey, l_linenumber, end_mp) AS before FROM sections) WHERE before < start_mp", "sections"))
def milepost_gaps(spark, d):
    w = Window.partitionBy("route_id").orderBy("start_mp", "l_orderkey", "l_linenumber", "end_mp")
    return V.sections(spark, d).withColumn("before", F.lag("end_mp").over(w)).where("before < start_mp").select("route_id", *_KEY, "start_mp")
