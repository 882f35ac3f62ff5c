"""Aggregates over curves, vertices, sweeps and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views as V
from ..config import BLIND_FT
from ..functions.classify import degree_bin, degree_of_curve, grade_bin
from ..operators import statistics as S
from ..operators.intervals import point_in_interval
from ..registry import query
from .joins import _BIN, _binned
from .sequence import SIGHT, sight

_C = f"+c AS (SELECT *, {_BIN} AS bin FROM curves)"


@query(V.sql("SELECT route_id, arg_min(f_system, (-n, f_system)) AS f_system FROM (SELECT route_id, f_system, count(*) AS n FROM sections GROUP BY ALL) GROUP BY 1", "sections"))
def predominant_fsystem(spark, d):
    return V.sections(spark, d).groupBy("route_id").agg(F.mode("f_system", True).alias("f_system"))


@query(V.sql("SELECT route_id, min(least(start_mp, end_mp)) AS low_mp, max(greatest(start_mp, end_mp)) AS high_mp, round(sum(end_mp - start_mp), 4) AS miles FROM sections GROUP BY 1", "sections"))
def route_extents(spark, d):
    return V.sections(spark, d).groupBy("route_id").agg(F.min(F.least("start_mp", "end_mp")).alias("low_mp"), F.max(F.greatest("start_mp", "end_mp")).alias("high_mp"), F.round(F.sum(F.col("end_mp") - F.col("start_mp")), 4).alias("miles"))


_RAW = "p AS (SELECT l_linenumber AS f_system, l_suppkey AS chunk, l_extendedprice / 1000 AS z, l_extendedprice / 1000 + l_discount AS zs, 45.0::DOUBLE + l_partkey / 1e5 AS lat, 45.0::DOUBLE + l_partkey / 1e5 + l_tax / 1e4 AS lat_s, -120.0::DOUBLE + l_partkey / 1e5 AS lon, -120.0::DOUBLE + l_partkey / 1e5 + l_discount / 1e4 AS lon_s FROM lineitem)"


def _raw(spark, d):
    p = V.table(spark, d, "lineitem")
    lat, lon = F.lit(45.0) + F.col("l_partkey") / 1e5, F.lit(-120.0) + F.col("l_partkey") / 1e5
    return p.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").alias("f_system"), F.col("l_suppkey").alias("chunk"), (F.col("l_extendedprice") / 1000).alias("z"), (F.col("l_extendedprice") / 1000 + F.col("l_discount")).alias("zs"), lat.alias("lat"), (lat + F.col("l_tax") / 1e4).alias("lat_s"), lon.alias("lon"), (lon + F.col("l_discount") / 1e4).alias("lon_s"))


@query(f"WITH {_RAW} SELECT f_system, chunk, round(sqrt(avg(pow(z - zs, 2))) * 3.28084, 6) AS v_rmse_ft, round(sqrt(avg(pow((lat - lat_s) * 364000, 2) + pow((lon - lon_s) * 364000 * cos(radians(lat_s)), 2))), 4) AS h_rmse_ft FROM p GROUP BY 1, 2")
def health_rmse(spark, d):
    h = F.pow((F.col("lat") - F.col("lat_s")) * 364000, 2) + F.pow((F.col("lon") - F.col("lon_s")) * 364000 * F.cos(F.radians("lat_s")), 2)
    return _raw(spark, d).groupBy("f_system", "chunk").agg(F.round(F.sqrt(F.avg(F.pow(F.col("z") - F.col("zs"), 2))) * 3.28084, 6).alias("v_rmse_ft"), F.round(F.sqrt(F.avg(h)), 4).alias("h_rmse_ft"))


@query(V.sql("SELECT f_system, round(quantile_cont(iri, 0.5), 6) AS p50, round(quantile_cont(iri, 0.8), 6) AS p80, round(quantile_cont(iri, 0.95), 6) AS p95 FROM sections GROUP BY 1", "sections"))
def health_percentiles(spark, d):
    return S.percentiles(V.sections(spark, d), ["f_system"], "iri", (0.5, 0.8, 0.95))


@query(V.sql(f"{_C} SELECT bin, coalesce(n, 0) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E'), ('F')) v(bin) LEFT JOIN (SELECT bin, count(*) AS n FROM c WHERE f_system = 3 AND dir = 'Left' GROUP BY 1) USING (bin)", "curves"))
def bin_counts_zero_fill(spark, d):
    return S.bin_counts(_binned(spark, d).where("f_system = 3 and dir = 'Left'"), "bin")


@query(V.sql(f"{_C} SELECT f_system, {', '.join(f"count(*) FILTER (bin = '{x}') AS n_{x.lower()}" for x in 'ABCDEF')} FROM c GROUP BY 1", "curves"))
def bins_by_fsystem(spark, d):
    return S.crosstab(_binned(spark, d), "f_system", "bin")


@query(V.sql("""+m AS (SELECT f_system, sum(length_m) / 1609.34 AS miles FROM (SELECT f_system, length_m FROM curves WHERE dir = 'Left' UNION ALL SELECT f_system, length_m FROM curves WHERE kind = 'SAG') GROUP BY 1),
    h AS (SELECT f_system, count(*) AS n FROM curves WHERE dir = 'Left' GROUP BY 1), v AS (SELECT f_system, count(*) AS n FROM curves WHERE kind = 'SAG' GROUP BY 1)
    SELECT f_system, round(coalesce(h.n, 0) / miles * 100, 6) AS h_per_100, round(coalesce(v.n, 0) / miles * 100, 6) AS v_per_100 FROM m LEFT JOIN h USING (f_system) LEFT JOIN v USING (f_system)""", "curves"))  # fmt: skip
def curve_density(spark, d):
    c = V.curves(spark, d)
    return S.curve_density(c.where("dir = 'Left'"), c.where("kind = 'SAG'"))


@query(V.sql(f"{_C}, n AS (SELECT bin, coalesce(n, 0) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E'), ('F')) v(bin) LEFT JOIN (SELECT bin, count(*) AS n FROM c GROUP BY 1) USING (bin)) SELECT bin, round(sum(n) OVER (ORDER BY bin) * 100.0::DOUBLE / sum(n) OVER (), 6) AS cum_pct FROM n", "curves"))
def severity_cdf(spark, d):
    return S.severity_cdf(_binned(spark, d), "bin")


@query(V.sql("SELECT f_system, count(*) FILTER (kind = 'CREST') AS crest, count(*) FILTER (kind = 'SAG') AS sag FROM curves GROUP BY 1", "curves"))
def crest_sag(spark, d):
    return V.curves(spark, d).groupBy("f_system").agg(F.count_if(F.col("kind") == "CREST").alias("crest"), F.count_if(F.col("kind") == "SAG").alias("sag"))


@query(V.sql("SELECT f_system, round(avg((merge_status = 'Compound')::INT::DOUBLE), 6) AS compound, round(avg((transition = 'Spiral')::INT::DOUBLE), 6) AS spiral FROM curves GROUP BY 1", "curves"))
def compound_share(spark, d):
    return V.curves(spark, d).groupBy("f_system").agg(S.share(F.col("merge_status") == "Compound").alias("compound"), S.share(F.col("transition") == "Spiral").alias("spiral"))


@query(V.sql("SELECT bin, count(*) AS n FROM (SELECT least(39, floor(least(length_m / abs(alg_diff), 500) / 12.5))::INT AS bin FROM curves WHERE abs(alg_diff) > 0.01) GROUP BY 1", "curves"))
def k_histogram(spark, d):
    k = F.least(F.col("length_m") / F.abs("alg_diff"), F.lit(500.0))
    return V.curves(spark, d).where(F.abs("alg_diff") > 0.01).groupBy(F.least(F.lit(39), F.floor(k / 12.5)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


_SEEN = f"""+{SIGHT}, q AS (SELECT s.*, EXISTS (SELECT 1 FROM curves c WHERE kind = 'SAG' AND c.route_id = (s.route_id % 50)::VARCHAR AND idx * 50 / 5280.0::DOUBLE BETWEEN c_start AND c_end) AS sag FROM sight s)"""


@query(V.sql(f"{_SEEN} SELECT route_id, count(*) AS n, round(avg((asd_ft < 400)::INT::DOUBLE), 6) AS blind, round(avg((asd_ft < 400 AND NOT sag)::INT::DOUBLE), 6) AS blind_not_sag FROM q GROUP BY 1", "profile", "curves"))
def blind_share(spark, d):
    """Share of samples with too short a sight distance; for a plan's sheet those in sags don't count."""
    p = sight(spark, d).withColumn("on", (F.col("route_id") % 50).cast("string")).withColumn("mp", F.col("idx") * 50 / 5280.0)
    sags = V.curves(spark, d).where("kind = 'SAG'")
    v = point_in_interval(p.select(F.col("on").alias("route_id"), F.col("route_id").alias("own"), "idx", "mp", "asd_ft"), sags, "mp", "c_start", "c_end", "curve_id", "kind", ["own", "idx", "asd_ft"])
    blind = F.col("asd_ft") < BLIND_FT
    return v.groupBy(F.col("own").alias("route_id")).agg(F.count("*").alias("n"), S.share(blind).alias("blind"), S.share(blind & F.col("kind").isNull()).alias("blind_not_sag"))


@query(V.sql("SELECT round(avg(radius_m), 4) AS radius_m, round(avg(length_m), 4) AS length_m, round(avg(abs(alg_diff)), 6) AS alg_diff, round(min(radius_m), 4) AS tightest, count(*) AS n FROM curves", "curves"))
def kpi_means(spark, d):
    return V.curves(spark, d).agg(F.round(F.avg("radius_m"), 4).alias("radius_m"), F.round(F.avg("length_m"), 4).alias("length_m"), F.round(F.avg(F.abs("alg_diff")), 6).alias("alg_diff"), F.round(F.min("radius_m"), 4).alias("tightest"), F.count("*").alias("n"))


@query("SELECT o_custkey, least(ceil(384.16::DOUBLE / (1 + 383.16::DOUBLE / count(*)))::BIGINT, count(*)) AS n FROM orders GROUP BY 1")
def cochran(spark, d):
    g = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("m"))
    return g.select("o_custkey", S.sample_size(F.col("m")).alias("n"))


_M = "m AS (SELECT grp, factor, count(*) AS n, round(avg(rmse), 6) AS rmse, round(quantile_cont(max_dev, 0.8), 6) AS dev_p80, round(stddev_pop(rmse), 6) AS rmse_sd FROM sweep GROUP BY 1, 2 HAVING count(*) >= 3)"
_G = f"{_M}, g AS (SELECT *, rmse <= [4.0, 4.5, 3.5, 3.5, 4.0, 4.0, 4.0][grp % 7 + 1] AND dev_p80 <= [35.0, 30.0, 15.0, 12.0, 15.0, 15.0, 15.0][grp % 7 + 1] + CASE WHEN grp % 2 = 0 THEN 8 ELSE 0 END AS passed FROM m)"


def _gates(spark, d):
    m = S.collated(V.sweep(spark, d), ["grp", "factor"])
    return S.gated(m, "V", F.col("grp") % 7 + 1, F.col("grp") % 2 == 0)


@query(V.sql(f"+{_M} SELECT * FROM m", "sweep"))
def collate_metrics(spark, d):
    return S.collated(V.sweep(spark, d), ["grp", "factor"])


@query(V.sql(f"+{_G} SELECT grp, factor, rmse, dev_p80, passed FROM g", "sweep"))
def gate_pass(spark, d):
    return _gates(spark, d).select("grp", "factor", "rmse", "dev_p80", "passed")


_EXIT = f"""{_G}, a_x AS (SELECT *, coalesce(NOT passed AND rmse >= lag(rmse) OVER w, NOT passed AND lag(rmse) OVER w IS NULL) AS bad, bool_or(passed) OVER w AS any_pass FROM g WINDOW w AS (PARTITION BY grp ORDER BY factor)),
    b_x AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY grp ORDER BY factor) AS run FROM a_x), c_x AS (SELECT *, any_pass AND sum(bad::INT) OVER (PARTITION BY grp, run ORDER BY factor) >= 3 AS stop FROM b_x),
    e_x AS (SELECT *, coalesce(bool_or(stop) OVER (PARTITION BY grp ORDER BY factor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM c_x)"""


@query(V.sql(f"+{_EXIT} SELECT grp, factor, rmse, dev_p80, passed FROM e_x WHERE NOT gone", "sweep"))
def sweep_early_exit(spark, d):
    return S.early_exit(_gates(spark, d), "grp")


_E = """e AS (SELECT grp, factor, rmse, count(*) OVER (PARTITION BY grp) AS n, first_value(factor) OVER w AS f0, last_value(factor) OVER w AS f1, first_value(rmse) OVER w AS r0, last_value(rmse) OVER w AS r1 FROM {src} WINDOW w AS (PARTITION BY grp ORDER BY factor ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    k AS (SELECT *, round(CASE WHEN n < 3 THEN 0.0::DOUBLE ELSE coalesce(abs((rmse - r0) / nullif(r1 - r0, 0) - (factor - f0) / nullif(f1 - f0, 0)) / sqrt(2.0::DOUBLE), 0) END, 9) AS dist FROM e),
    bend AS (SELECT grp, arg_min(factor, (-dist, factor)) AS factor, round(max(dist), 6) AS peak, any_value(n) AS n, round(any_value(r1 - r0), 6) AS rise FROM k GROUP BY 1)"""


@query(V.sql(f"+{_M}, {_E.format(src='m')} SELECT * FROM bend", "sweep"))
def elbow(spark, d):
    return S.elbow(S.collated(V.sweep(spark, d), ["grp", "factor"]), "grp")


def _choice(src: str) -> str:
    """What is chosen of the gates in `src`: sel (grp, method, factor, passes, peak, rise, confidence)."""
    return f"""pg AS (SELECT * FROM {src} WHERE passed), {_E.format(src='pg')}, t AS (SELECT grp, max(rmse) - min(rmse) AS range, count(*) FILTER (passed) AS passes, max(factor) FILTER (passed) AS highest FROM {src} GROUP BY 1),
    s0 AS (SELECT grp, CASE WHEN range < 0.05 THEN 'flat_terrain_default' WHEN passes >= 3 THEN 'elbow' WHEN passes > 0 THEN 'highest_safe' ELSE 'composite_fallback' END AS method,
    (CASE WHEN range < 0.05 THEN [1400, 1400, 1400, 1400, 1000, 1000, 1000][grp % 7 + 1] WHEN passes >= 3 THEN bend.factor WHEN passes > 0 THEN highest ELSE 100 END)::INT AS factor, passes, CASE WHEN range >= 0.05 AND passes >= 3 THEN peak ELSE 0.0::DOUBLE END AS peak, CASE WHEN passes >= 2 THEN rise ELSE 0.0::DOUBLE END AS rise FROM t LEFT JOIN bend USING (grp)),
    sel AS (SELECT *, least(least(50.0::DOUBLE, trunc(peak * 100)) + trunc(least(passes, 10) / 10.0::DOUBLE * 30) + trunc(least(rise, 1.0::DOUBLE) * 20), CASE method WHEN 'composite_fallback' THEN 25 WHEN 'highest_safe' THEN 50 ELSE 100 END)::INT AS confidence FROM s0)"""


@query(V.sql(f"+{_G}, {_choice('g')} SELECT grp, method, confidence FROM sel", "sweep"))
def confidence(spark, d):
    return S.selected(_gates(spark, d), "grp", "V", F.col("grp") % 7 + 1).select("grp", "method", "confidence")


@query(V.sql(f"+{_G}, {_choice('g')} SELECT grp, method, factor, passes, peak, rise FROM sel", "sweep"))
def factor_select(spark, d):
    return S.selected(_gates(spark, d), "grp", "V", F.col("grp") % 7 + 1).drop("confidence")


@query(V.sql(f"""+{_EXIT}, x AS (SELECT grp, factor, rmse, dev_p80, passed FROM e_x WHERE NOT gone), {_choice('x')},
    a AS (SELECT grp, count(*) AS n_evaluated, coalesce(max(CASE WHEN factor = 100 THEN 100 END), min(factor)) AS base, max(factor) FILTER (passed)::INT AS last_passing, coalesce(string_agg(factor::VARCHAR, '|' ORDER BY factor) FILTER (passed), '') AS passing_factors FROM x GROUP BY 1)
    SELECT grp, (grp % 7 + 1)::INT AS f_system, 'V' AS mode, n_evaluated, passes AS n_passing, passing_factors, round(rise, 4) AS rmse_rise, method AS selection_method, sel.factor AS selected_factor, round(peak, 4) AS peak_elbow_distance,
    round(b.rmse, 4) AS rmse_at_baseline, round(b.dev_p80, 4) AS dev_at_baseline, round(c.rmse, 4) AS rmse_at_selected, round(c.dev_p80, 4) AS dev_at_selected, last_passing, round(l.rmse, 4) AS rmse_at_last_passing, round(l.dev_p80, 4) AS dev_at_last_passing,
    [1400, 1400, 1400, 1400, 1000, 1000, 1000][grp % 7 + 1] AS national_default, round(sel.factor / [1400, 1400, 1400, 1400, 1000, 1000, 1000][grp % 7 + 1], 3) AS deviation_from_default, round(round(c.rmse, 4) / [4.0, 4.5, 3.5, 3.5, 4.0, 4.0, 4.0][grp % 7 + 1]::DOUBLE * 100, 1) AS ceiling_proximity_pct,
    confidence AS confidence_score, method <> 'elbow' AS override_recommended
    FROM a JOIN sel USING (grp) LEFT JOIN x b ON b.grp = a.grp AND b.factor = base LEFT JOIN x c ON c.grp = a.grp AND c.factor = sel.factor LEFT JOIN x l ON l.grp = a.grp AND l.factor = last_passing""", "sweep"))  # fmt: skip
def audit_derivation(spark, d):
    return S.audit_rows(S.early_exit(_gates(spark, d), "grp"), "grp", "V", F.col("grp") % 7 + 1)


_SCORED = f"""{_G}, z AS (SELECT *, rmse * 0.8 AS h_rmse, dev_p80 * 0.6 AS h_dev, 4.0::DOUBLE / factor AS curve_var, [4.0, 4.5, 3.5, 3.5, 4.0, 4.0, 4.0][grp % 7 + 1]::DOUBLE AS vr, [3.5, 3.5, 3.8, 3.8, 5.0, 5.5, 5.5][grp % 7 + 1]::DOUBLE AS hr,
    [35.0, 30.0, 15.0, 12.0, 15.0, 15.0, 15.0][grp % 7 + 1]::DOUBLE + CASE WHEN grp % 2 = 0 THEN 8 ELSE 0 END AS vd, [15.0, 15.0, 22.0, 22.0, 15.0, 15.0, 20.0][grp % 7 + 1]::DOUBLE AS hd FROM g),
    sc AS (SELECT *, curve_var / 0.05 * 100 + pow(rmse / vr, 2) * 20 + pow(h_rmse / hr, 2) * 20 + 500 * (greatest(rmse - vr, 0) + greatest(h_rmse - hr, 0) + greatest(dev_p80 - vd, 0) + greatest(h_dev - hd, 0)) AS score FROM z)"""


@query(V.sql(f"""+{_SCORED}, pg AS (SELECT * FROM g WHERE passed), {_E.format(src='pg')}, t AS (SELECT grp, count(*) FILTER (passed) AS passes, min(factor) FILTER (passed) AS lowest, max(factor) FILTER (passed) AS highest, arg_max(rmse, factor) FILTER (passed) - arg_min(rmse, factor) FILTER (passed) AS climb, arg_min(factor, (round(score, 6), factor)) AS composite FROM sc GROUP BY 1)
    SELECT grp, CASE WHEN passes >= 3 AND climb < 0.15 THEN 'flat_curve' WHEN passes >= 3 THEN 'elbow' WHEN passes > 0 THEN 'highest_safe' ELSE 'composite_fallback' END AS method, (CASE WHEN passes >= 3 AND climb < 0.15 THEN lowest WHEN passes >= 3 THEN bend.factor WHEN passes > 0 THEN highest ELSE composite END)::INT AS factor, passes FROM t LEFT JOIN bend USING (grp)""", "sweep"))  # fmt: skip
def factor_select_composite(spark, d):
    g = _gates(spark, d).withColumns({"v_rmse": F.col("rmse"), "h_rmse": F.col("rmse") * 0.8, "v_dev": F.col("dev_p80"), "h_dev": F.col("dev_p80") * 0.6, "curve_var": 4.0 / F.col("factor")})
    return S.selected_composite(g.withColumn("score", S.composite_score(F.col("grp") % 7 + 1, F.col("grp") % 2 == 0)), "grp")


@query(V.sql("""SELECT *, round(composite_fallback / n, 6) AS fallback_rate, CASE WHEN composite_fallback / n >= 0.35 THEN 'ALERT' WHEN composite_fallback / n >= 0.2 THEN 'WARN' ELSE 'OK' END AS flag FROM (SELECT f_system, mode, count(*) AS n,
    count(*) FILTER (method = 'elbow') AS elbow, count(*) FILTER (method = 'highest_safe') AS highest_safe, count(*) FILTER (method = 'flat_terrain_default') AS flat_terrain_default, count(*) FILTER (method = 'composite_fallback') AS composite_fallback FROM audit GROUP BY 1, 2)""", "audit"))  # fmt: skip
def method_breakdown(spark, d):
    return S.method_breakdown(V.audit(spark, d))


@query(V.sql("""SELECT *, CASE WHEN near_pct >= 50 THEN 'ALERT' WHEN near_pct >= 25 THEN 'WARN' ELSE 'OK' END AS flag FROM (SELECT f_system, mode, round(avg(proximity), 6) AS mean, round(quantile_cont(proximity, 0.5), 6) AS median, round(avg((proximity >= 85)::INT::DOUBLE) * 100, 6) AS near_pct FROM audit GROUP BY 1, 2)""", "audit"))
def ceiling_proximity(spark, d):
    return S.ceiling_proximity(V.audit(spark, d))


@query(V.sql("""SELECT *, CASE WHEN weak_pct >= 40 THEN 'ALERT' WHEN weak_pct >= 20 THEN 'WARN' ELSE 'OK' END AS flag FROM (SELECT f_system, mode, count(*) AS n, round(avg(confidence), 6) AS mean, min(confidence) AS least, round(avg((confidence < 40)::INT::DOUBLE) * 100, 6) AS weak_pct FROM audit WHERE method = 'elbow' GROUP BY 1, 2)""", "audit"))
def confidence_distribution(spark, d):
    return S.confidence_distribution(V.audit(spark, d))


@query(V.sql("""+w AS (SELECT *, avg(factor) OVER p AS m, stddev_samp(factor) OVER p AS s FROM audit WINDOW p AS (PARTITION BY f_system, mode))
    SELECT f_system, mode, count(*) AS n, round(avg(factor), 6) AS mean, round(stddev_samp(factor), 6) AS sd, round(stddev_samp(factor) / avg(factor) * 100, 6) AS cv_pct, min(factor) AS least, max(factor) AS most,
    coalesce(string_agg(state || ':' || flag, ',' ORDER BY state || ':' || flag) FILTER (abs(factor - m) > 2 * s), '') AS outliers FROM w GROUP BY 1, 2 HAVING count(*) >= 2""", "audit"))  # fmt: skip
def factor_stability(spark, d):
    return S.factor_stability(V.audit(spark, d))


@query(V.sql("""+g AS (SELECT f_system, avg((method = 'composite_fallback')::INT::DOUBLE) AS fb, avg((proximity >= 85)::INT::DOUBLE) * 100 AS near, avg(proximity) AS prox, coalesce(avg((confidence < 40)::INT::DOUBLE) FILTER (method = 'elbow') * 100, 0) AS weak FROM audit GROUP BY 1),
    s AS (SELECT f_system, CASE WHEN fb >= 0.35 THEN 2 WHEN fb >= 0.2 THEN 1 ELSE 0 END + CASE WHEN near >= 50 THEN 2 WHEN near >= 25 THEN 1 ELSE 0 END AS tight, CASE WHEN prox < 40 THEN 1 ELSE 0 END + CASE WHEN weak >= 40 THEN 1 ELSE 0 END AS loose FROM g)
    SELECT *, CASE WHEN tight >= 2 AND tight > loose THEN 'TOO TIGHT' WHEN loose >= 2 AND loose > tight THEN 'TOO LOOSE' WHEN tight + loose > 0 THEN 'REVIEW' ELSE 'OK' END AS verdict FROM s""", "audit"))  # fmt: skip
def threshold_verdict(spark, d):
    return S.verdict(V.audit(spark, d))


@query(V.sql(f"SELECT state, {', '.join(f'round(avg(proximity) FILTER (f_system = {k}), 6) AS fs{k}' for k in range(1, 8))} FROM audit WHERE mode = 'V' GROUP BY 1", "audit"))
def proximity_heatmap(spark, d):
    return V.audit(spark, d).where("mode = 'V'").groupBy("state").agg(*[F.round(F.avg(F.when(F.col("f_system") == k, F.col("proximity"))), 6).alias(f"fs{k}") for k in range(1, 8)])


@query("SELECT l_linenumber, min(try_cast(l_returnflag AS DOUBLE)) AS none_min, min(l_tax) AS least, max(l_tax) AS most, round(avg(l_tax), 6) AS mean FROM lineitem GROUP BY 1")
def numeric_summaries(spark, d):
    x = V.table(spark, d, "lineitem")
    return x.groupBy("l_linenumber").agg(F.min(F.col("l_returnflag").try_cast("double")).alias("none_min"), F.min("l_tax").alias("least"), F.max("l_tax").alias("most"), F.round(F.avg("l_tax"), 6).alias("mean"))


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey"]


@query(f"""WITH {_RAW.replace("AS (SELECT l_linenumber AS f_system", "AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber AS f_system")}, v AS (SELECT f_system, chunk, abs(z - zs) * 3.28084 AS v, sqrt(pow((lat - lat_s) * 364000, 2) + pow((lon - lon_s) * 364000 * cos(radians(lat_s)), 2)) AS h, l_orderkey, l_linenumber, l_partkey, degrees(atan2(lead(lat_s) OVER w - lat_s, lead(lon_s) OVER w - lon_s)) AS head FROM p WINDOW w AS (PARTITION BY f_system, chunk ORDER BY l_orderkey, l_linenumber, l_partkey)),
    t AS (SELECT *, abs(((head - lag(head) OVER w + 180) % 360 + 360) % 360 - 180) AS turn FROM v WINDOW w AS (PARTITION BY f_system, chunk ORDER BY l_orderkey, l_linenumber, l_partkey))
    SELECT f_system, chunk, round(sqrt(avg(v * v)), 6) AS v_rmse, round(sqrt(avg(h * h)), 4) AS h_rmse, round(max(v), 6) AS max_v_dev, round(max(h), 4) AS max_h_dev, round(avg(turn), 4) AS curve_var FROM t GROUP BY 1, 2""")  # fmt: skip
def chunk_metrics(spark, d):
    return S.deviations(_raw(spark, d), ["f_system", "chunk"], _ORDER)


_SENS = """p AS (SELECT route_id, idx, (route_id % 4 + 1) * 200 AS factor, z, avg(z) OVER (PARTITION BY route_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS zs, degrees(idx * 0.01 + sin(idx * 0.3) * (route_id % 7)) AS heading FROM profile)"""


@query(V.sql(f"""+{_SENS}, q AS (SELECT factor, route_id, abs(z - zs) AS dev, radians(lead(heading) OVER w - heading) / 5 AS k, (lead(zs) OVER w - zs) / 5 AS g FROM p WINDOW w AS (PARTITION BY factor, route_id ORDER BY idx)),
    c AS (SELECT factor, route_id, var_pop(k) AS k, sqrt(avg(dev * dev)) * 3.28084 AS rmse, max(dev) * 3.28084 AS most, var_pop(g) AS g FROM q GROUP BY 1, 2) SELECT factor, round(avg(k), 9) AS h_variance, round(avg(rmse), 6) AS v_rmse, round(avg(most), 6) AS v_max, round(avg(g), 6) AS v_variance FROM c GROUP BY 1""", "profile"))  # fmt: skip
def sensitivity_metrics(spark, d):
    w = Window.partitionBy("route_id").orderBy("idx").rowsBetween(-2, 2)
    i = F.col("idx")
    p = V.profile(spark, d).select("route_id", "idx", ((F.col("route_id") % 4 + 1) * 200).alias("factor"), "z", F.avg("z").over(w).alias("zs"), F.degrees(i * 0.01 + F.sin(i * 0.3) * (F.col("route_id") % 7)).alias("heading"))
    return S.sensitivity(p, "factor", ["route_id"], "idx", 5.0)


@query(V.sql("SELECT curve_id, CASE WHEN 1746.38::DOUBLE / radius_m < 3.5 THEN 'A' WHEN 1746.38::DOUBLE / radius_m < 5.5 THEN 'B' WHEN 1746.38::DOUBLE / radius_m < 8.5 THEN 'C' WHEN 1746.38::DOUBLE / radius_m < 14 THEN 'D' WHEN 1746.38::DOUBLE / radius_m < 28 THEN 'E' ELSE 'F' END AS h_bin, CASE WHEN abs(alg_diff) < 0.5 THEN 'A' WHEN abs(alg_diff) < 2.5 THEN 'B' WHEN abs(alg_diff) < 4.5 THEN 'C' WHEN abs(alg_diff) < 6.5 THEN 'D' WHEN abs(alg_diff) < 8.5 THEN 'E' ELSE 'F' END AS v_bin FROM curves", "curves"))
def curve_classes(spark, d):
    return V.curves(spark, d).select("curve_id", degree_bin(degree_of_curve(F.col("radius_m"))).alias("h_bin"), grade_bin(F.col("alg_diff")).alias("v_bin"))
