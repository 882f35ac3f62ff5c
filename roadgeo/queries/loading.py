"""Normalising, decoding and filtering what was loaded."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions.classify import clearance_m
from ..operators import cleaning as K
from ..registry import query


@query("""SELECT upper(trim(p_brand)) AS "RouteId", coalesce(try_cast(p_name AS DOUBLE), 0.0) AS "Start_MP", coalesce(p_retailprice, 0.0) AS "End_MP", coalesce(trunc(try_cast(p_type AS DOUBLE)), 1)::INT AS "FSystem", coalesce(trunc(p_size::DOUBLE), 2)::INT AS "Facility_Type", 0 AS "Structure_Type", 'LINESTRING (0 0, 1 ' || p_size || ')' AS "WKT", p_partkey FROM part WHERE p_size % 7 <> 0""")
def normalize_sections(spark, d):
    p = V.table(spark, d, "part")
    line = F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("LINESTRING (0 0, 1 "), F.col("p_size").cast("string"), F.lit(")")))
    raw = p.select(F.concat(F.lit(" "), F.lower("p_brand")).alias("route_id"), F.col("p_name").alias("bmp"), F.col("p_retailprice").cast("string").alias("emp"), F.col("p_type").alias("func_sys"), F.col("p_size").cast("string").alias("Facility_typ"), line.alias("the_geom"), "p_partkey")
    return K.normalized(raw)


@query(V.sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, state FROM sections WHERE state = '05'", "sections"))
def state_filter(spark, d):
    s = V.sections(spark, d).withColumn("State_FIPS", F.col("state").cast("int"))
    return K.for_state(s, "5").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "state")


@query(V.sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM sections WHERE facility_type IN (1, 2) AND f_system IN (1, 3, 4)", "sections"))
def facility_fsystem_filter(spark, d):
    return K.among(V.sections(spark, d), facility_type=[1, 2], f_system=[1, 3, 4], structure_type=[]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(V.sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, start_mp, end_mp FROM sections WHERE route_id = '7' AND start_mp <= 900 AND end_mp >= 500", "sections"))
def route_clip(spark, d):
    return K.route_clip(V.sections(spark, d), " 7", 500, 900).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "start_mp", "end_mp")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_parse(spark, d):
    return V.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT item, replace(replace(regexp_replace(replace(t, '&', '&amp;'), '&amp;([A-Za-z0-9#]+;)', '&\\1', 'g'), 'x', 'x'), 'y', 'y') AS clean FROM (SELECT page_id AS item, html AS t FROM pages)""")
def ampersand_sanitize(spark, d):
    return V.table(spark, d, "pages").select(F.col("page_id").alias("item"), K.bare_ampersands(F.col("html")).alias("clean"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '0' WHEN c_custkey % 3 = 1 THEN (47123456 + c_custkey)::VARCHAR ELSE ((c_custkey % 80) + 0.5)::VARCHAR END AS lat, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN (122304050 + c_custkey % 50)::VARCHAR ELSE (-(c_custkey % 170) - 0.25)::VARCHAR END AS lon FROM customer),
    p AS (SELECT *, lpad(lat, 8, '0') AS a, lpad(lon, 9, '0') AS o FROM c)
    SELECT c_custkey, round(CASE WHEN lat::DOUBLE = 0 THEN NULL WHEN abs(lat::DOUBLE) > 90 THEN substr(a, 1, 2)::DOUBLE + substr(a, 3, 2)::DOUBLE / 60 + substr(a, 5, 4)::DOUBLE / 100 / 3600 ELSE lat::DOUBLE END, 6) AS lat,
    round(CASE WHEN lon IS NULL THEN NULL WHEN lon::DOUBLE > 180 THEN -(substr(o, 1, 3)::DOUBLE + substr(o, 4, 2)::DOUBLE / 60 + substr(o, 6, 4)::DOUBLE / 100 / 3600) ELSE lon::DOUBLE END, 6) AS lon FROM p""")  # fmt: skip
def ddmmss_decode(spark, d):
    k = F.col("c_custkey")
    lat = F.when(k % 3 == 0, "0").when(k % 3 == 1, (k + 47123456).cast("string")).otherwise(((k % 80) + 0.5).cast("string"))
    lon = F.when(k % 3 == 1, (k % 50 + 122304050).cast("string")).when(k % 3 == 2, (-(k % 170) - 0.25).cast("string"))
    c = V.table(spark, d, "customer").select("c_custkey", lat.alias("LAT_016"), lon.alias("LONG_017"))
    return c.select("c_custkey", F.round(K.decimal_degrees(K.first_of(c, ("LAT_016", "I13", "LATITUDE")), False), 6).alias("lat"), F.round(K.decimal_degrees(K.first_of(c, ("LONG_017", "I14")), True), 6).alias("lon"))


@query("""SELECT s_suppkey, round(CASE WHEN m > 0 THEN m END, 6) AS clearance_m FROM (SELECT s_suppkey, CASE WHEN regexp_full_match(t, '[0-9]{4}') THEN t::DOUBLE / 100 ELSE try_cast(t AS DOUBLE) / 3.28084 END AS m FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN lpad((s_suppkey * 7)::VARCHAR, 4, '0') WHEN 1 THEN '14.5' WHEN 2 THEN 'N/A' ELSE '-3' END AS t FROM supplier))""")
def clearance_decode(spark, d):
    k = F.col("s_suppkey")
    t = F.when(k % 4 == 0, F.lpad((k * 7).cast("string"), 4, "0")).when(k % 4 == 1, " 14.5").when(k % 4 == 2, "N/A").otherwise("-3")
    return V.table(spark, d, "supplier").select("s_suppkey", F.round(clearance_m(t), 6).alias("clearance_m"))


@query("SELECT DISTINCT l_suppkey::VARCHAR AS route_id FROM lineitem ORDER BY 1")
def distinct_routes(spark, d):
    return V.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("route_id")).distinct().orderBy("route_id")


@query("""SELECT page_id, trim(regexp_replace(url, '[<>:"/\\\\|?*]+', '-', 'g')) AS name FROM pages""")
def safe_route_name(spark, d):
    return V.table(spark, d, "pages").select("page_id", K.safe_route_name(F.col("url")).alias("name"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01'")
def field_projection(spark, d):
    return V.table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'2000-01-01'").select("l_orderkey", "l_linenumber", "l_quantity")
