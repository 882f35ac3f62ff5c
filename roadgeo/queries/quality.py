"""Deduplication, set operations, validators and cache eviction."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import geo as G
from ..functions.classify import grade_bin
from ..operators import cleaning as K
from ..registry import query
from .geometry import _LINE, _lines
from .joins import _binned
from .statistics import _C



@query(V.sql("SELECT route_id, start_mp, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY route_id, start_mp ORDER BY l_orderkey, l_linenumber, end_mp) AS k FROM sections) WHERE k = 1", "sections"))
def dedup_vertices(spark, d):
    return K.first_by(V.sections(spark, d), ["route_id", "start_mp"], ["l_orderkey", "l_linenumber", "end_mp"]).select("route_id", "start_mp", "l_orderkey", "l_linenumber")


@query(V.sql(f"{_C} SELECT route_id, c_start, c_end, curve_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY route_id, c_start, c_end ORDER BY curve_id) AS k FROM c) WHERE k = 1 ORDER BY route_id, c_start, c_end", "curves"))
def dedup_curves(spark, d):
    return K.first_by(_binned(spark, d), ["route_id", "c_start", "c_end"], ["curve_id"]).select("route_id", "c_start", "c_end", "curve_id", "bin").orderBy("route_id", "c_start", "c_end")


@query("SELECT o_orderstatus, o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def dedup_intersections(spark, d):
    return K.first_by(V.table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).select("o_orderstatus", "o_custkey", "o_orderkey")


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_per_state(spark, d):
    return K.latest(V.table(spark, d, "orders"), "o_custkey", "o_orderdate", ["o_orderkey"])


@query("SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance, NULL::VARCHAR AS note FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL, s_name FROM supplier")
def national_merge(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("note"))
    return c.unionByName(s, allowMissingColumns=True)


@query(V.sql("SELECT route_id, 'tight' AS exception FROM curves WHERE radius_m < 50 UNION SELECT route_id, 'steep' FROM curves WHERE abs(alg_diff) > 9.5 UNION SELECT route_id, 'rough' FROM sections WHERE iri > 75", "sections", "curves"))
def qa_exceptions(spark, d):
    c, s = V.curves(spark, d), V.sections(spark, d)
    parts = [c.where("radius_m < 50").select("route_id", F.lit("tight").alias("exception")), c.where("abs(alg_diff) > 9.5").select("route_id", F.lit("steep").alias("exception")), s.where("iri > 75").select("route_id", F.lit("rough").alias("exception"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def _rules(src: str, name: str, rules: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, '{r}' AS rule, '{s}' AS severity, count(*) FILTER ({c}) AS n FROM {src}" for r, s, c in rules)


_BROKEN = "CASE WHEN curve_id % 50 = 0 THEN -length_m WHEN curve_id % 51 = 0 THEN NULL ELSE length_m END AS length_m, c_start, CASE WHEN curve_id % 77 = 0 THEN c_start ELSE c_end END AS c_end"


@query(V.sql(f"{_C}, b AS (SELECT {_BROKEN}, radius_m, CASE WHEN curve_id % 90 = 0 THEN NULL ELSE dir END AS dir, CASE WHEN curve_id % 60 = 0 THEN 'Z' ELSE bin END AS bin FROM c) {_rules('b', 'horizontal', K.HORIZONTAL_RULES)}", "curves"))
def validate_horizontal(spark, d):
    b = _binned(spark, d).withColumn("length_m", F.expr(_BROKEN.split(" AS length_m")[0])).withColumn("c_end", F.when(F.col("curve_id") % 77 == 0, F.col("c_start")).otherwise(F.col("c_end")))
    b = b.withColumn("dir", F.when(F.col("curve_id") % 90 != 0, F.col("dir"))).withColumn("bin", F.when(F.col("curve_id") % 60 == 0, "Z").otherwise(F.col("bin")))
    return K.violations(b, "horizontal", K.HORIZONTAL_RULES)


_GB = "CASE WHEN abs(alg_diff) < 0.5 THEN 'A' WHEN abs(alg_diff) < 2.5 THEN 'B' WHEN abs(alg_diff) < 4.5 THEN 'C' WHEN abs(alg_diff) < 6.5 THEN 'D' WHEN abs(alg_diff) < 8.5 THEN 'E' ELSE 'F' END"


@query(V.sql(f"+b AS (SELECT {_BROKEN}, length_m / alg_diff AS k_value, CASE WHEN curve_id % 90 = 0 THEN 'FLAT' ELSE kind END AS kind, {_GB} AS grade_bin FROM curves WHERE abs(alg_diff) > 0.001) {_rules('b', 'vertical', K.VERTICAL_RULES)}", "curves"))
def validate_vertical(spark, d):
    c = V.curves(spark, d).where("abs(alg_diff) > 0.001").withColumn("k_value", F.col("length_m") / F.col("alg_diff")).withColumn("grade_bin", grade_bin(F.col("alg_diff")))
    b = c.withColumn("length_m", F.expr(_BROKEN.split(" AS length_m")[0])).withColumn("c_end", F.when(F.col("curve_id") % 77 == 0, F.col("c_start")).otherwise(F.col("c_end"))).withColumn("kind", F.when(F.col("curve_id") % 90 == 0, "FLAT").otherwise(F.col("kind")))
    return K.violations(b, "vertical", K.VERTICAL_RULES)


@query(V.sql(f"+b AS (SELECT CASE WHEN hole THEN NULL ELSE z END AS z, z - 200 AS grade, z - lag(z) OVER (PARTITION BY route_id ORDER BY idx) AS step, CASE WHEN idx % 30 = 0 THEN 'x' ELSE 'None' END AS tier FROM profile) {_rules('b', 'vertices', K.VERTEX_RULES)}", "profile"))
def validate_vertices(spark, d):
    from pyspark.sql import Window

    step = F.col("z") - F.lag("z").over(Window.partitionBy("route_id").orderBy("idx"))
    b = V.profile(spark, d).withColumn("step", step).withColumn("grade", F.col("z") - 200).withColumn("tier", F.when(F.col("idx") % 30 == 0, "x").otherwise("None")).withColumn("z", F.when(~F.col("hole"), F.col("z")))
    return K.violations(b, "vertices", K.VERTEX_RULES)


@query(V.sql(f"+b AS (SELECT CASE WHEN l_partkey % 40 = 0 THEN '' ELSE route_id END AS route_id, start_mp, end_mp, CASE WHEN l_linenumber = 7 THEN NULL ELSE 'A' END AS h_bin FROM sections) {_rules('b', 'scores', K.SCORE_RULES)}", "sections"))
def validate_scores(spark, d):
    b = V.sections(spark, d).withColumn("route_id", F.when(F.col("l_partkey") % 40 == 0, "").otherwise(F.col("route_id"))).withColumn("h_bin", F.when(F.col("l_linenumber") != 7, "A"))
    return K.violations(b, "scores", K.SCORE_RULES)


@query(f"WITH {_LINE} SELECT vec_id, vec_id % 5 = 0 AS zero_z, vec_id % 3 = 0 AS zero_m FROM l")
def wkt_zm_stats(spark, d):
    k = F.col("vec_id")
    p = F.transform("pts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.when(k % 5 == 0, 0.0).otherwise(p["x"] + 200).alias("z"), F.when(k % 3 == 0, 0.0).otherwise(p["y"] + 1).alias("m")))
    return K.incomplete_zm(_lines(spark, d).withColumn("wkt_zm", G.wkt_zm(p))).select("vec_id", "zero_z", "zero_m")


@query("WITH f AS (SELECT p_partkey, p_size, p_retailprice, sum(p_size) OVER () AS total, coalesce(sum(p_size) OVER (ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM part) SELECT p_partkey, p_size FROM f WHERE total > 40000 AND total - before > 36000")
def lru_evict(spark, d):
    return K.evicted(V.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", "p_size", "p_retailprice", 40_000).select("p_partkey", "p_size")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY hash_key, p_partkey) AS k FROM (SELECT p_brand, p_partkey, (p_partkey * 7919) % 10007 AS hash_key FROM part)) WHERE k <= 5")
def sample_routes(spark, d):
    from pyspark.sql import Window

    p = V.table(spark, d, "part").withColumn("h", F.col("p_partkey") * 7919 % 10007)
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("h", "p_partkey"))
    return p.withColumn("k", k).where("k <= 5").select("p_brand", "p_partkey")


def _report_rules(src: str, name: str, rules: list[tuple[str, str, str]], numbers: list[str]) -> str:
    sizes = f"SELECT '{name}' AS table_name, 'rows' AS \"check\", 'info' AS severity, count(*) AS n, NULL::DOUBLE AS value FROM {src}"
    counts = "".join(f" UNION ALL SELECT '{name}', '{r}', '{s}', count(*) FILTER ({c}), NULL FROM {src}" for r, s, c in rules)
    ends = "".join(f" UNION ALL SELECT '{name}', '{k} of {c}', 'info', NULL, round({f}({c}), 4) FROM {src}" for c in numbers for k, f in (("min", "min"), ("mean", "avg"), ("max", "max")))
    return sizes + counts + ends


@query(V.sql(f"""{_C}, b AS (SELECT route_id, {_BROKEN}, radius_m, dir, bin FROM c), s AS (SELECT route_id, start_mp, end_mp, 'A' AS h_bin FROM sections),
    r AS ({_report_rules('b', 'horizontal', K.HORIZONTAL_RULES, ['radius_m'])} UNION ALL {_report_rules('s', 'scores', K.SCORE_RULES, [])} UNION ALL SELECT 'lost', 'rows', 'info', count(*), NULL FROM s UNION ALL SELECT 'lost', 'missing wkt_zm', 'issue', 1, NULL),
    p AS (SELECT *, severity <> 'issue' OR n = 0 AS passed FROM r) SELECT * FROM p UNION ALL SELECT '', 'result', 'info', NULL, NULL, bool_and(passed) FROM p""", "sections", "curves"))  # fmt: skip
def validation_report(spark, d):
    b = _binned(spark, d).withColumn("length_m", F.expr(_BROKEN.split(" AS length_m")[0])).withColumn("c_end", F.when(F.col("curve_id") % 77 == 0, F.col("c_start")).otherwise(F.col("c_end")))
    s = V.sections(spark, d).withColumn("h_bin", F.lit("A"))
    return K.report({"horizontal": (b, K.HORIZONTAL_RULES, ["length_m", "c_start", "c_end"], ["radius_m", "gone"]), "scores": (s, K.SCORE_RULES, ["route_id"], []), "lost": (s, K.SCORE_RULES, ["route_id", "wkt_zm"], [])})
