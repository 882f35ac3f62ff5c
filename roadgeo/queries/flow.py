"""The alignment flow over sections of 25 made-up routes; kernels have no SQL twin, the tests hold each stage against plain forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import views as V
from ..config import Params
from ..functions import geo as G
from ..operators import intervals
from ..operators.attributes import attributes, interval
from ..plans import calibration, enrichment, flow
from ..plans.alignment import spread
from ..registry import query

#: Degrees of a sample of the lines, cells of a degree in the raster.
_STEP, _PER_DEGREE = 1.27e-4, 2400


def sections(spark, d) -> DataFrame:
    """Customers as sections of 25 winding routes, end to end in the order of their ids; some are bridges."""
    k = F.col("c_custkey")
    i = F.floor(k / 25)
    at = lambda j: F.format_string("%.7f %.7f", (F.lit(-120.4) + (i * 4 + j) * _STEP).cast("double"), (F.lit(45.2) + (k % 25) * 0.01 + F.sin((i * 4 + j) / 20) * 4.5e-4).cast("double"))
    line = F.concat(F.lit("LINESTRING ("), F.array_join(F.array(*map(at, range(5))), ", "), F.lit(")"))
    kind = F.when(i % 40 == 7, 1).otherwise(0)
    return V.table(spark, d, "customer").select((k % 25).cast("string").alias("RouteId"), (k % 7 + 1).cast("int").alias("FSystem"), (i * 0.025).alias("Start_MP"), ((i + 1) * 0.025).alias("End_MP"), kind.alias("Structure_Type"), line.alias("WKT"))


def structures(spark, d) -> DataFrame:
    """Suppliers as bridges on the routes."""
    k = F.col("s_suppkey")
    j = k * 7 % 200 * 4
    return V.table(spark, d, "supplier").select(k.alias("structure_id"), (F.lit(-120.4) + j * _STEP).alias("lon"), (F.lit(45.2) + (k % 25) * 0.01 + F.sin(j / 20) * 4.5e-4).alias("lat"), F.lpad((k * 7 % 1000).cast("string"), 4, "0").alias("vertical_clearance"))


def raster(spark, d) -> DataFrame:
    """Hills over the strip of the one-degree tile that the routes lie in, roughened by the sizes of parts; some cells are voids."""
    n = V.table(spark, d, "customer").agg(F.max("c_custkey").alias("k")).select((F.floor(F.col("k") / 25 * 4 * _STEP * _PER_DEGREE) + 4).alias("wide"))
    row, col = F.explode(F.sequence(F.lit(1200), F.lit(1930))), F.explode(F.sequence(F.lit(1430), F.lit(1445) + F.col("wide")))
    cells = spread(n.select(F.col("wide"), row.alias("row")), "row").select("row", col.alias("col"))
    part = V.table(spark, d, "part").select("p_partkey", "p_size")
    size = part.agg(F.max("p_partkey").alias("n"))
    cells = cells.crossJoin(F.broadcast(size)).withColumn("p_partkey", F.pmod(F.col("row") * 31 + F.col("col"), "n") + 1).join(part, "p_partkey", "left")  # size is one row
    z = F.lit(120.0) + 15 * F.sin(F.col("col") / 9) + 6 * F.cos(F.col("row") / 5) + F.coalesce("p_size", F.lit(25)) / 50
    return cells.select(G.tile_name(F.lit(-120.4), F.lit(45.2)).alias("tile"), "row", "col", F.when((F.col("row") + F.col("col")) % 97 != 0, z).otherwise(-9999.0).alias("z"))


#: Alignments that this process has written, by session and data: queries over one state read the same tables.
_WRITTEN: dict[tuple[str, str], flow.Alignment] = {}


def _flow(spark, d) -> flow.Alignment:
    key = (spark.sparkContext.applicationId, d)
    if key not in _WRITTEN:
        _WRITTEN[key] = flow.aligned(sections(spark, d), structures(spark, d), raster(spark, d), Params(merge=True))
    return _WRITTEN[key]


def _rounded(df: DataFrame, *columns: str):
    return [F.round(c, 4).alias(c) for c in columns]


@query()
def alignment(spark, d):
    """Every vertex of the smoothed alignment with its profile."""
    v = _flow(spark, d).vertices
    return v.select("path", "idx", "RouteId", *_rounded(v, "Milepost", "x", "y", "z", "heading", "grade", "roughness"))


@query()
def alignment_full(spark, d):
    """Every vertex: position, elevation, tier, curve, sight distance."""
    v = _flow(spark, d).vertices
    return v.select("path", "idx", "RouteId", "FSystem", "Structure_Tier", "curve", *_rounded(v, "Milepost", "lon", "lat", "lon_raw", "lat_raw", "Elev_Ft", "z_raw", "heading", "grade", "roughness", "asd_ft"))


@query()
def alignment_horizontal(spark, d):
    """Horizontal curves, merged, with their geometry."""
    h = _flow(spark, d).horizontal
    return h.select("path", "RouteId", "FSystem", "dir", "transition", "merge_status", "bin", "banking", G.wkt_line(F.col("points")).alias("wkt"), *_rounded(h, "Part", "start_mp", "end_mp", "radius_m", "min_radius_m", "length_m", "delta"))


@query()
def alignment_vertical(spark, d):
    """Crests and sags."""
    u = _flow(spark, d).vertical
    return u.select("path", "RouteId", "FSystem", "kind", "bin", "false_valley", *_rounded(u, "Part", "start_mp", "end_mp", "length_m", "grade_in", "grade_out", "alg_diff", "k_value"))


@query()
def alignment_scores(spark, d):
    """Sections with their worst classes."""
    s = _flow(spark, d).scores
    return s.select("RouteId", "FSystem", "h_bin", "v_bin", *_rounded(s, "start_mp", "end_mp"))


@query()
def plan_profile_pages(spark, d):
    """Pages of the plan of one route between two mileposts."""
    r = flow.plan_profile(sections(spark, d), structures(spark, d), raster(spark, d), Params(), "7", 0.0, 1.5).pages
    return r.select("path", "page", "idx", *_rounded(r, "x", "y", "mp"))


def _state(spark, d) -> DataFrame:
    """The sections with one functional system a route, so that chains of miles belong to it."""
    return sections(spark, d).withColumn("FSystem", (F.col("RouteId").cast("int") % 3 + 1).cast("int"))


@query()
def calibration_sweep(spark, d):
    """Five metrics of every sampled mile under every factor of the profile."""
    _, at = calibration.drawn_points(_state(spark, d), Params())
    s = calibration.swept(at, raster(spark, d), Params(), "V")
    return s.select("chunk", "FSystem", "factor", *_rounded(s, "v_rmse", "h_rmse", "max_v_dev", "max_h_dev", "curve_var"))


@query()
def calibration_audit_v(spark, d):
    """Audit rows of the profiles' factors."""
    return calibration.audited(_state(spark, d), raster(spark, d), Params(state="53"), "V").drop("timestamp")


@query()
def calibration_audit_h(spark, d):
    """Audit rows of the paths' factors."""
    return calibration.audited(_state(spark, d), raster(spark, d), Params(state="53"), "H", True).drop("timestamp")


@query()
def enrich_4d(spark, d):
    """Sections with the elevations of the flow's vertices at their own."""
    s = sections(spark, d)
    return enrichment.enriched(s, _flow(spark, d).vertices, raster(spark, d)).select("RouteId", "Start_MP", "End_MP", "WKT_ZM", "Elevation_Source")


def given_vertices(spark, d) -> DataFrame:
    """Orders as smoothed vertices about the routes 0 to 18."""
    k = F.col("o_orderkey")
    part = k % 3
    return V.table(spark, d, "orders").select(
        (F.col("o_custkey") % 19).cast("string").alias("RouteId"), part.cast("double").alias("low"), F.concat_ws("/", (F.col("o_custkey") % 19).cast("string"), (part + 1).cast("string")).alias("path"), k.cast("long").alias("idx"),
        F.when(part < 2, 32610).otherwise(32611).alias("epsg"), (F.lit(-120.41) + (k * 37 % 997) * 0.00005).alias("lon"), (F.lit(45.195) + (k * 61 % 1009) * 0.00001).alias("lat"), (F.col("o_totalprice") / 1000 + 1e-7).alias("z"),
    )


def given_sections(spark, d) -> DataFrame:
    """Suppliers as sections of two parts on the routes 0 to 19."""
    k = F.col("s_suppkey")
    x = lambda j, i: F.lit(-120.4) + (k % 20) * 0.002 + j * 0.0007 + i * 0.00021 + (k % 7) * 0.00003
    y = lambda j, i: F.lit(45.2) + (k % 13) * 0.0004 + i * 0.00017 - j * 0.0003
    part = lambda j: F.concat(F.lit("("), F.array_join(F.array(*[F.format_string("%.7f %.7f", x(j, i), y(j, i)) for i in range(3)]), ", "), F.lit(")"))
    return V.table(spark, d, "supplier").select(k.alias("section_id"), (k % 20).cast("string").alias("RouteId"), (k * 0.1).alias("Start_MP"), (k * 0.1 + 0.5).alias("End_MP"), F.concat(F.lit("MULTILINESTRING ("), part(0), F.lit(", "), part(1), F.lit(")")).alias("WKT"))


_EN = G.utm_sql("lon", "lat", "zone")


@query(f"""WITH v AS (SELECT (o_custkey % 19)::VARCHAR AS route, (o_orderkey % 3)::DOUBLE AS low, o_orderkey AS idx, CASE WHEN o_orderkey % 3 < 2 THEN 32610 ELSE 32611 END AS epsg,
        -120.41::DOUBLE + (o_orderkey * 37 % 997) * 0.00005::DOUBLE AS lon, 45.195::DOUBLE + (o_orderkey * 61 % 1009) * 0.00001::DOUBLE AS lat, o_totalprice / 1000 + 1e-7::DOUBLE AS z FROM orders),
    zones AS (SELECT route, epsg AS zone FROM v QUALIFY row_number() OVER (PARTITION BY route ORDER BY low, idx) = 1),
    p AS (SELECT s_suppkey AS section_id, (s_suppkey % 20)::VARCHAR AS route, s_suppkey * 0.1::DOUBLE AS a, s_suppkey * 0.1::DOUBLE + 0.5::DOUBLE AS b, j, i,
        printf('%.7f', -120.4::DOUBLE + (s_suppkey % 20) * 0.002::DOUBLE + j * 0.0007::DOUBLE + i * 0.00021::DOUBLE + (s_suppkey % 7) * 0.00003::DOUBLE)::DOUBLE AS lon,
        printf('%.7f', 45.2::DOUBLE + (s_suppkey % 13) * 0.0004::DOUBLE + i * 0.00017::DOUBLE - j * 0.0003::DOUBLE)::DOUBLE AS lat FROM supplier, (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1, 2]) AS i)),
    mine AS (SELECT p.*, {_EN[0]} AS x, {_EN[1]} AS y FROM p JOIN zones USING (route)),
    far AS (SELECT route, low, idx, z, {_EN[0]} AS x, {_EN[1]} AS y FROM v JOIN zones USING (route)),
    step AS (SELECT *, CASE WHEN i > 0 THEN sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) ELSE 0 END AS s FROM mine WINDOW w AS (PARTITION BY section_id ORDER BY j, i)),
    m AS (SELECT *, a + sum(s) OVER (PARTITION BY section_id ORDER BY j, i) / sum(s) OVER (PARTITION BY section_id) * (b - a) AS m FROM step),
    nn AS (SELECT m.section_id, m.j, m.i, m.lon, m.lat, m.m, far.z FROM m JOIN far USING (route) QUALIFY row_number() OVER (PARTITION BY section_id, j, i ORDER BY floor(sqrt(pow(m.x - far.x, 2) + pow(m.y - far.y, 2)) * 1e9 + 0.5) / 1e9, low, idx) = 1),
    r AS (SELECT 1900 + p_partkey % 30 AS row, 1528 + p_partkey // 30 % 12 AS col, max(p_retailprice) / 10 + 1e-7::DOUBLE AS z FROM part GROUP BY ALL),
    bare AS (SELECT section_id, j, i, lon, lat, CASE WHEN j + i > 0 THEN sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)) ELSE 0 END AS s, a, b FROM p WHERE route NOT IN (SELECT route FROM zones) WINDOW w AS (PARTITION BY section_id ORDER BY j, i)),
    n AS (SELECT section_id, j, i, lon, lat, a + sum(s) OVER (PARTITION BY section_id ORDER BY j, i) / sum(s) OVER (PARTITION BY section_id) * (b - a) AS m, coalesce(z, 0) AS z FROM bare LEFT JOIN r ON row = floor((46 - lat) * 2400) AND col = floor((lon + 121) * 2400)),
    every AS (SELECT section_id, j, i, lon, lat, z, m, 'smoothed' AS source FROM nn UNION ALL SELECT section_id, j, i, lon, lat, z, m, 'raw_fallback' FROM n)
    SELECT section_id, 'LINESTRING ZM (' || string_agg(printf('%.7f %.7f %.2f %.4f', lon, lat, z, m), ', ' ORDER BY j, i) || ')' AS wkt_zm, any_value(source) AS elevation_source FROM every GROUP BY section_id""")  # fmt: skip
def enrich_given(spark, d):
    """Sections with the elevations of given vertices, or of a raster where their route has none."""
    k = F.col("p_partkey")
    cells = V.table(spark, d, "part").groupBy((F.lit(1900) + k % 30).alias("row"), (F.lit(1528) + F.floor(k / 30) % 12).alias("col")).agg((F.max("p_retailprice") / 10 + 1e-7).alias("z")).withColumn("tile", F.lit("n46w121"))
    e = enrichment.enriched(given_sections(spark, d), given_vertices(spark, d), cells)
    return e.select("section_id", F.col("WKT_ZM").alias("wkt_zm"), F.col("Elevation_Source").alias("elevation_source"))


@query(V.sql("""+p AS (SELECT a.route_id AS ra, b.route_id AS rb, a.node_id AS ia, b.node_id AS ib, abs(a.elev - b.elev) AS dz, a.lon, a.lat, a.elev AS ea, b.elev AS eb FROM nodes a JOIN nodes b ON a.route_id < b.route_id AND sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) <= 4.5e-5)
    SELECT ra AS route_a, rb AS route_b, CASE WHEN dz > 10 THEN 'Grade-Separated' ELSE 'At-Grade' END AS topology_node, round(lon, 6) AS lon, round(lat, 6) AS lat, ia / 10.0::DOUBLE AS mp_a, ib / 10.0::DOUBLE AS mp_b, round(ea, 4) AS elev_a_ft, round(eb, 4) AS elev_b_ft, round(dz, 4) AS elev_diff_ft
    FROM p WHERE dz > 10 OR dz <= 5 QUALIFY row_number() OVER (PARTITION BY ra, rb ORDER BY ia, ib) = 1""", "nodes"))  # fmt: skip
def flow_intersections(spark, d):
    """Crossings of routes whose vertices are given."""
    n = V.nodes(spark, d)
    v = n.select(F.lit(0.0).alias("low"), F.lit("1").alias("path"), F.col("node_id").alias("idx"), F.col("route_id").alias("RouteId"), "lon", "lat", F.col("elev").alias("Elev_Ft"), (F.col("node_id") / 10.0).alias("Milepost"))
    x = flow.intersections(v).withColumnsRenamed({c: c.lower() for c in ("Route_A", "Route_B", "Topology_Node", "Lon", "Lat", "MP_A", "MP_B", "Elev_A_Ft", "Elev_B_Ft", "Elev_Diff_Ft")})
    return x.select("route_a", "route_b", "topology_node", "mp_a", "mp_b", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), *_rounded(x, "elev_a_ft", "elev_b_ft", "elev_diff_ft"))


_SEQ = "((l_orderkey * 10 + l_linenumber) * 10000 + l_partkey) * 1000 + (end_mp - start_mp)::BIGINT"


@query(V.sql(f"""+p AS (SELECT (user_id % 50)::VARCHAR AS route_id, event_id, (event_id % 2000)::DOUBLE AS mp FROM events),
    h AS (SELECT route_id, event_id, arg_max(dir, curve_id) AS h_type, arg_max(CASE WHEN 1746.38::DOUBLE / radius_m < 5.5 THEN 'low' ELSE 'high' END, curve_id) AS h_bin FROM p JOIN curves USING (route_id) WHERE curve_id % 3 > 0 AND mp BETWEEN c_start AND c_end GROUP BY ALL),
    v AS (SELECT route_id, event_id, arg_max(kind, curve_id) AS v_type FROM p JOIN curves USING (route_id) WHERE curve_id % 3 < 2 AND mp BETWEEN c_start AND c_end GROUP BY ALL),
    q AS (SELECT route_id, start_mp, end_mp, {_SEQ} AS seq, max(iri) AS iri, bool_or(structure_type IN (1, 2)) AS known FROM sections GROUP BY ALL),
    i AS (SELECT route_id, event_id, round(arg_max(iri, seq), 6) AS iri, bool_or(known) AS on_structure FROM p JOIN q USING (route_id) WHERE mp BETWEEN start_mp AND end_mp GROUP BY ALL)
    SELECT route_id, event_id, mp, h_type, h_bin, v_type, iri, coalesce(on_structure, false) AS on_structure FROM p LEFT JOIN h USING (route_id, event_id) LEFT JOIN v USING (route_id, event_id) LEFT JOIN i USING (route_id, event_id)""", "sections", "curves"))  # fmt: skip
def vertex_attributes(spark, d):
    """All that holds at a vertex, from intervals of five attributes, in one pass over each route."""
    e, c, s = V.table(spark, d, "events"), V.curves(spark, d), V.sections(spark, d)
    p = e.select((F.col("user_id") % 50).cast("string").alias("route_id"), "event_id", (F.col("event_id") % 2000).cast("double").alias("mp"))
    seq = (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000 + F.col("l_partkey")) * 1000 + (F.col("end_mp") - F.col("start_mp")).cast("long")).alias("seq")
    q = s.groupBy("route_id", "start_mp", "end_mp", seq).agg(F.max("iri").alias("iri"), F.bool_or(F.col("structure_type").isin(1, 2)).alias("known"))
    turn = lambda df, name, value: df.select(*interval(name, "mp", "c_start", "c_end", ["curve_id"], value, "route_id"))
    h, v = c.where("curve_id % 3 > 0"), c.where("curve_id % 3 < 2")
    row = lambda df, name, value: df.select(*interval(name, "mp", "start_mp", "end_mp", ["seq"], value, "route_id"))
    every = turn(h, "h_type", "dir").unionByName(turn(h, "h_bin", F.when(F.lit(1746.38) / F.col("radius_m") < 5.5, "low").otherwise("high"))).unionByName(turn(v, "v_type", "kind"))
    every = every.unionByName(row(q, "iri", "iri")).unionByName(row(q.where("known"), "on_structure", "known"))
    got = attributes(p, every, "route_id", "event_id", ["mp"], ["h_type", "h_bin", "v_type", "iri", "on_structure"])
    return p.join(got.withColumns({"iri": F.round(F.col("iri").cast("double"), 6), "on_structure": F.col("on_structure").isNotNull()}), ["route_id", "event_id"])


@query(V.sql("""+p AS (SELECT (user_id % 50)::VARCHAR AS route_id, event_id, (event_id % 2000)::DOUBLE AS mp FROM events),
    t AS (SELECT p.*, EXISTS (SELECT 1 FROM sections s WHERE s.route_id = p.route_id AND structure_type IN (1, 2) AND start_mp < end_mp AND mp BETWEEN start_mp AND end_mp) AS one FROM p),
    n AS (SELECT route_id, count(*) AS vertices, count(*) FILTER (one) AS tier_1, count(*) FILTER (NOT one AND event_id % 11 = 0) AS tier_2, count(*) FILTER (NOT one AND event_id % 11 > 0 AND event_id % 13 = 0) AS tier_3 FROM t GROUP BY 1),
    c AS (SELECT route_id, count(*) AS spirals FROM curves WHERE transition = 'Spiral' GROUP BY 1)
    SELECT route_id, vertices, tier_1, tier_2, tier_3, round((tier_1 + tier_2) / vertices, 6) AS known_share, coalesce(spirals, 0) AS spirals FROM n LEFT JOIN c USING (route_id)""", "sections", "curves"))  # fmt: skip
def tier_counts(spark, d):
    """Vertices of each structure tier, and spirals, of every route."""
    e = V.table(spark, d, "events")
    p = e.select((F.col("user_id") % 50).cast("string").alias("route_id"), "event_id", (F.col("event_id") % 2000).cast("double").alias("mp"))
    one = intervals.on_structures(p, V.sections(spark, d).select("route_id", "structure_type", "start_mp", "end_mp"), "mp", ["event_id"])
    tier = F.when(F.col("on_structure"), "1_HPMS").when(F.col("event_id") % 11 == 0, "2_NBI").when(F.col("event_id") % 13 == 0, "3_DIP").otherwise("None")
    t = flow.tiers(one.select(F.col("route_id").alias("RouteId"), tier.alias("Structure_Tier")), V.curves(spark, d).withColumnRenamed("route_id", "RouteId"))
    return t.withColumnRenamed("RouteId", "route_id").withColumn("known_share", F.round("known_share", 6))


@query("""WITH v AS (SELECT c_nationkey AS path, -120.0::DOUBLE + c_custkey % 97 / 1000.0::DOUBLE AS lon_raw, 45.0::DOUBLE + c_custkey % 89 / 1000.0::DOUBLE AS lat_raw, (c_custkey % 7 - 3) / 1000000.0::DOUBLE AS a, (c_custkey % 5 - 2) / 1000000.0::DOUBLE AS b, c_acctbal / 100 AS z_raw, c_acctbal / 100 + (c_custkey % 3) / 4.0::DOUBLE AS z FROM customer)
    SELECT path::VARCHAR AS path, round(sqrt(avg(pow((z_raw - z) * 3.28084::DOUBLE, 2))), 4) AS rmse_v, round(sqrt(avg(pow((lat_raw - (lat_raw + a)) * 364000::DOUBLE, 2) + pow((lon_raw - (lon_raw + b)) * 364000::DOUBLE * cos(radians(lat_raw + a)), 2))), 3) AS rmse_h FROM v GROUP BY 1""")  # fmt: skip
def vertex_health(spark, d):
    """RMSE of chains from their own vertices."""
    k = F.col("c_custkey")
    v = V.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("path"), (F.lit(-120.0) + k % 97 / 1000.0).alias("lon_raw"), (F.lit(45.0) + k % 89 / 1000.0).alias("lat_raw"), ((k % 7 - 3) / 1000000.0).alias("a"), ((k % 5 - 2) / 1000000.0).alias("b"), (F.col("c_acctbal") / 100).alias("z_raw"), (F.col("c_acctbal") / 100 + k % 3 / 4.0).alias("z"))
    h = flow.health(v.withColumns({"lat": F.col("lat_raw") + F.col("a"), "lon": F.col("lon_raw") + F.col("b"), "RouteId": F.col("path"), "FSystem": F.lit(1)}))
    return h.select("path", F.round("RMSE_V_ft", 4).alias("rmse_v"), F.round("RMSE_H_ft", 3).alias("rmse_h"))


@query()
def alignment_table(spark, d):
    """Vertices as published."""
    return flow.vertex_table(_flow(spark, d).vertices, "53")
