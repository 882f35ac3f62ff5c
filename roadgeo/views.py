"""The driver's tables seen as road data: one DataFrame and one DuckDB text for each view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Road sections with milepost ranges; the key is of four columns."""
    li, su = table(spark, d, "lineitem"), table(spark, d, "supplier")
    # Suppliers are joined with whatever strategy their size allows; the lines are never broadcast.
    return li.join(su, li.l_suppkey == su.s_suppkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_suppkey").cast("string").alias("route_id"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("state"), F.col("l_linenumber").alias("f_system"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(4).alias("facility_type"), (F.col("l_partkey") % 20).cast("int").alias("structure_type"),
        F.col("l_partkey").cast("double").alias("start_mp"), (F.col("l_partkey") + F.col("l_quantity")).alias("end_mp"), (F.col("l_tax") * 1000).alias("iri"),
    )


def curves(spark: SparkSession, d: str) -> DataFrame:
    """Horizontal and vertical measures of curves in one row each."""
    n = table(spark, d, "supplier").agg(F.count("*").alias("n_routes"))
    o = table(spark, d, "orders").crossJoin(F.broadcast(n))  # one row
    k = F.col("o_orderkey")
    r, a = F.col("o_totalprice") / 200, F.pmod(F.col("o_totalprice") / 1000, F.lit(20.0)) - 10
    return o.select(
        k.alias("curve_id"), (F.col("o_custkey") % F.col("n_routes")).cast("string").alias("route_id"), (k % 2000).cast("double").alias("c_start"), (k % 2000 + 10).cast("double").alias("c_end"), (k % 7 + 1).cast("int").alias("f_system"),
        r.alias("radius_m"), F.when(k % 2 == 0, "Right").otherwise("Left").alias("dir"), (F.col("o_custkey") % 90).cast("double").alias("delta"), F.when(k % 5 == 0, "Compound").otherwise("Simple").alias("merge_status"),
        F.when(k % 4 == 0, "Spiral").otherwise("Simple").alias("transition"), (F.lit(50.0) + k % 400).alias("length_m"), a.alias("alg_diff"), F.when(a < 0, "CREST").otherwise("SAG").alias("kind"),
    )


def profile(spark: SparkSession, d: str) -> DataFrame:
    """Elevation samples of a route in order, 5 units apart."""
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, d, "events").select(F.col("user_id").alias("route_id"), idx.cast("long").alias("idx"), F.col("value").alias("z"), (F.col("event_id") % 10 == 0).alias("hole"), "event_id")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Points of routes, many of them within some 1e-5 degrees of each other."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("node_id"), F.col("c_nationkey").cast("string").alias("route_id"), (F.lit(-125.0) + (k % 60) / 100.0 + (k % 7) * 0.00001).alias("lon"), (F.lit(25.0) + (k % 24) / 100.0).alias("lat"), F.pmod("c_acctbal", F.lit(30.0)).alias("elev"))


def structures(spark: SparkSession, d: str) -> DataFrame:
    """Bridges with a clearance in four digits."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("structure_id"), (F.lit(-125.0) + (k % 60) / 100.0 + 0.00003).alias("lon"), (F.lit(25.0) + (k % 24) / 100.0 + 0.00002).alias("lat"), F.lpad((k * 7 % 10000).cast("string"), 4, "0").alias("vertical_clearance"))


def audit(spark: SparkSession, d: str) -> DataFrame:
    """Calibration audit rows: state, functional system, mode, method, factor, confidence, proximity."""
    li, su = table(spark, d, "lineitem"), table(spark, d, "supplier")
    g = li.join(su, li.l_suppkey == su.s_suppkey).groupBy(F.col("s_nationkey").alias("nation"), F.col("l_linenumber").alias("f_system"), F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    method = F.when(F.col("n") % 5 == 0, "composite_fallback").when(F.col("n") % 5 == 1, "highest_safe").when(F.col("n") % 5 == 2, "flat_terrain_default").otherwise("elbow")
    return g.select(F.lpad(F.col("nation").cast("string"), 2, "0").alias("state"), "f_system", F.when(F.col("flag") == "R", "H").otherwise("V").alias("mode"), "flag", method.alias("method"), (F.col("q") % 15 * 100 + 100).cast("int").alias("factor"), (F.col("q") % 101).cast("int").alias("confidence"), (F.col("q") % 1000 / 10.0).alias("proximity"))


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """RMSE of chunks under smoothing factors: (group, chunk, factor, rmse, max_dev)."""
    p = table(spark, d, "part")
    k = F.explode(F.array(*[F.lit(x) for x in (100, 200, 400, 800, 1600, 3200)])).alias("factor")
    e = p.select((F.col("p_partkey") % 40).cast("int").alias("grp"), F.col("p_partkey").alias("chunk"), F.col("p_size"), k)
    rmse = F.sqrt(F.col("factor").cast("double")) / 20 + F.col("p_size") / 25.0 + F.col("chunk") % 11 / 20.0
    return e.select("grp", "chunk", "factor", rmse.alias("rmse"), (rmse * 4).alias("max_dev"))


#: DuckDB texts of the views, in an order that lets each use those before it.
SQL = {
    "sections": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey::VARCHAR AS route_id, lpad(s_nationkey::VARCHAR, 2, '0') AS state, l_linenumber AS f_system,
        CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 4 END AS facility_type, (l_partkey % 20)::INT AS structure_type, l_partkey::DOUBLE AS start_mp, l_partkey + l_quantity AS end_mp, l_tax * 1000 AS iri
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "curves": """SELECT o_orderkey AS curve_id, (o_custkey % (SELECT count(*) FROM supplier))::VARCHAR AS route_id, (o_orderkey % 2000)::DOUBLE AS c_start, (o_orderkey % 2000 + 10)::DOUBLE AS c_end, (o_orderkey % 7 + 1)::INT AS f_system,
        o_totalprice / 200 AS radius_m, CASE WHEN o_orderkey % 2 = 0 THEN 'Right' ELSE 'Left' END AS dir, (o_custkey % 90)::DOUBLE AS delta, CASE WHEN o_orderkey % 5 = 0 THEN 'Compound' ELSE 'Simple' END AS merge_status,
        CASE WHEN o_orderkey % 4 = 0 THEN 'Spiral' ELSE 'Simple' END AS transition, 50.0::DOUBLE + o_orderkey % 400 AS length_m, (o_totalprice / 1000) % 20.0::DOUBLE - 10 AS alg_diff,
        CASE WHEN (o_totalprice / 1000) % 20.0::DOUBLE - 10 < 0 THEN 'CREST' ELSE 'SAG' END AS kind FROM orders""",
    "profile": "SELECT user_id AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS z, event_id % 10 = 0 AS hole, event_id FROM events",
    "nodes": """SELECT c_custkey AS node_id, c_nationkey::VARCHAR AS route_id, -125.0::DOUBLE + (c_custkey % 60) / 100.0::DOUBLE + (c_custkey % 7) * 0.00001::DOUBLE AS lon, 25.0::DOUBLE + (c_custkey % 24) / 100.0::DOUBLE AS lat,
        CASE WHEN c_acctbal % 30.0::DOUBLE < 0 THEN (c_acctbal % 30.0::DOUBLE + 30.0::DOUBLE) % 30.0::DOUBLE ELSE c_acctbal % 30.0::DOUBLE END AS elev FROM customer""",
    "structures": "SELECT s_suppkey AS structure_id, -125.0::DOUBLE + (s_suppkey % 60) / 100.0::DOUBLE + 0.00003::DOUBLE AS lon, 25.0::DOUBLE + (s_suppkey % 24) / 100.0::DOUBLE + 0.00002::DOUBLE AS lat, lpad((s_suppkey * 7 % 10000)::VARCHAR, 4, '0') AS vertical_clearance FROM supplier",
    "audit": """SELECT lpad(nation::VARCHAR, 2, '0') AS state, f_system, CASE WHEN flag = 'R' THEN 'H' ELSE 'V' END AS mode, flag,
        CASE n % 5 WHEN 0 THEN 'composite_fallback' WHEN 1 THEN 'highest_safe' WHEN 2 THEN 'flat_terrain_default' ELSE 'elbow' END AS method, (q % 15 * 100 + 100)::INT AS factor, (q % 101)::INT AS confidence, (q % 1000) / 10.0::DOUBLE AS proximity
        FROM (SELECT s_nationkey AS nation, l_linenumber AS f_system, l_returnflag AS flag, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)""",
    "sweep": """SELECT grp, chunk, factor, sqrt(factor::DOUBLE) / 20 + p_size / 25.0::DOUBLE + (chunk % 11) / 20.0::DOUBLE AS rmse, (sqrt(factor::DOUBLE) / 20 + p_size / 25.0::DOUBLE + (chunk % 11) / 20.0::DOUBLE) * 4 AS max_dev
        FROM (SELECT (p_partkey % 40)::INT AS grp, p_partkey AS chunk, p_size, unnest([100, 200, 400, 800, 1600, 3200]) AS factor FROM part)""",
}


def sql(body: str, *views: str) -> str:
    """A DuckDB query with the named views before it."""
    ctes = ", ".join(f"{v} AS ({SQL[v]})" for v in views)
    return f"WITH {ctes}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"
