"""Aggregates over curves, vertices, calibration sweeps and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    AUDIT_COLUMNS, CONFIDENCE_CAPS, CURVE_VARIATION, DEGREE_FT, EARLY_EXIT_FAILS, ELBOW_FLAT_FT, FALLBACK_ALERT, FALLBACK_WARN, FEET_PER_METER, FLAT_TERRAIN_FT, H_DEVIATION_FT, H_RMSE_CEILING_FT, H_SPLINE, METERS_PER_MILE_CHUNK, MOUNTAIN_EXTRA_FT, NEAR_CEILING_PCT, V_DEVIATION_FT, V_RMSE_CEILING_FT, V_SPLINE, WEAK_CONFIDENCE,
)

LETTERS = "ABCDEF"


def share(flag: Column, digits: int = 6) -> Column:
    """Share of rows with the flag set; halves are those of the scaled number, as in SQL, not of its shortest decimal."""
    return F.floor(F.avg(flag.cast("double")) * 10.0**digits + 0.5) / 10.0**digits


def percentiles(df: DataFrame, by: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """Interpolated percentiles of a value for each group."""
    return df.groupBy(*by).agg(*[F.round(F.percentile(F.col(value), F.lit(p)), 6).alias(f"p{round(p * 100)}") for p in at])


def bin_counts(df: DataFrame, bin_column: str) -> DataFrame:
    """Rows of each class A to F, 0 where a class has none."""
    all_bins = df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(f"('{x}')" for x in LETTERS)} AS t(bin)")
    counts = df.groupBy(F.col(bin_column).alias("bin")).agg(F.count("*").alias("n"))
    return all_bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def crosstab(df: DataFrame, by: str, bin_column: str) -> DataFrame:
    """Rows of each class for each group, as columns."""
    return df.groupBy(by).agg(*[F.count_if(F.col(bin_column) == x).alias(f"n_{x.lower()}") for x in LETTERS])


def severity_cdf(df: DataFrame, bin_column: str) -> DataFrame:
    """Share, in per cent, of curves in a class or a milder one."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # over six rows
    n = bin_counts(df, bin_column)
    return n.select("bin", F.round(F.sum("n").over(w) * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("cum_pct"))


def curve_density(h: DataFrame, v: DataFrame) -> DataFrame:
    """Curves of each functional system for 100 miles of curves of either kind."""
    miles = h.select("f_system", "length_m").unionByName(v.select("f_system", "length_m")).groupBy("f_system").agg((F.sum("length_m") / METERS_PER_MILE_CHUNK).alias("miles"))
    counts = h.groupBy("f_system").agg(F.count("*").alias("n_h")).join(v.groupBy("f_system").agg(F.count("*").alias("n_v")), "f_system", "full")
    rate = lambda c: F.round(F.coalesce(c, F.lit(0)) / F.col("miles") * 100, 6)
    return counts.join(miles, "f_system").select("f_system", rate("n_h").alias("h_per_100"), rate("n_v").alias("v_per_100"))


def by_system(values: tuple[float, ...], fs: Column) -> Column:
    """The value of a functional system from 1 to 7; that of the first for any other."""
    return F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.when(fs.between(1, 7), fs).otherwise(1).cast("int"))


def collated(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of a factor put together: mean RMSE, 80th percentile of deviations, population deviation; three chunks at least."""
    g = chunks.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("rmse"), 6).alias("rmse"), F.round(F.percentile("max_dev", F.lit(0.8)), 6).alias("dev_p80"), F.round(F.stddev_pop("rmse"), 6).alias("rmse_sd"))
    return g.where("n >= 3")


def gated(metrics: DataFrame, mode: str, fs: Column, mountain: Column) -> DataFrame:
    """Whether a factor's RMSE and deviation are within the ceilings of its mode and functional system."""
    rmse = by_system(H_RMSE_CEILING_FT if mode == "H" else V_RMSE_CEILING_FT, fs)
    dev = by_system(H_DEVIATION_FT if mode == "H" else V_DEVIATION_FT, fs)
    dev = dev if mode == "H" else dev + F.when(mountain, MOUNTAIN_EXTRA_FT).otherwise(0.0)
    return metrics.withColumn("passed", (F.col("rmse") <= rmse) & (F.col("dev_p80") <= dev))


def early_exit(gates: DataFrame, group: str) -> DataFrame:
    """Factors that a sweep tries: it ends after a pass once EARLY_EXIT_FAILS failures in a row had rising RMSE."""
    w = Window.partitionBy(group).orderBy("factor")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    before_it = F.lag("rmse").over(w)  # the first factor has none before it, and counts as rising
    bad = ~F.col("passed") & (before_it.isNull() | (F.col("rmse") >= before_it))
    flagged = gates.withColumn("bad", F.coalesce(bad, F.lit(False))).withColumn("any_pass", F.bool_or("passed").over(up))
    reset = flagged.withColumn("run", F.sum(F.when(~F.col("bad"), 1).otherwise(0)).over(up))
    in_run = Window.partitionBy(group, "run").orderBy("factor").rowsBetween(Window.unboundedPreceding, 0)
    fails = reset.withColumn("fails", F.sum(F.when(F.col("bad"), 1).otherwise(0)).over(in_run))
    over = fails.withColumn("stop", F.col("any_pass") & (F.col("fails") >= EARLY_EXIT_FAILS))
    before = Window.partitionBy(group).orderBy("factor").rowsBetween(Window.unboundedPreceding, -1)
    return over.withColumn("gone", F.coalesce(F.bool_or("stop").over(before), F.lit(False))).where(~F.col("gone")).select(group, "factor", "rmse", "dev_p80", "passed")


def chord_distances(points: DataFrame, group: str) -> DataFrame:
    """Points (factor, rmse) with dist, from the chord of their group's RMSE curve scaled to a unit square (0 of fewer than three), n and rise of the group."""
    w = Window.partitionBy(group)
    first, last = F.min(F.struct("factor", "rmse")).over(w), F.max(F.struct("factor", "rmse")).over(w)
    x = (F.col("factor") - first["factor"]) / F.nullif(last["factor"] - first["factor"], F.lit(0))
    y = (F.col("rmse") - first["rmse"]) / F.nullif(last["rmse"] - first["rmse"], F.lit(0.0))
    d = points.withColumn("n", F.count("*").over(w)).withColumn("dist", F.round(F.when(F.col("n") < 3, 0.0).otherwise(F.coalesce(F.abs(y - x) / F.sqrt(F.lit(2.0)), F.lit(0.0))), 9))
    return d.withColumn("rise", last["rmse"] - first["rmse"])


def elbow(points: DataFrame, group: str) -> DataFrame:
    """The factor farthest from the chord of a group's RMSE curve, the smallest of equals; the first of fewer than three."""
    d = chord_distances(points, group)
    g = d.groupBy(group).agg(F.min(F.struct((-F.col("dist")).alias("d"), "factor")).alias("b"), F.first("n").alias("n"), F.first("rise").alias("rise"))
    return g.select(group, F.col("b.factor").cast("int").alias("factor"), F.round(-F.col("b.d"), 6).alias("peak"), "n", F.round("rise", 6).alias("rise"))


def confidence(method: Column, peak: Column, n: Column, rise: Column) -> Column:
    """0 to 100: height of the elbow, number of passing factors, rise of the curve, each truncated to whole points; a fallback has a cap of its own."""
    raw = F.least(F.lit(50.0), peak * 100).cast("int") + (F.least(n, F.lit(10)) / 10.0 * 30).cast("int") + (F.least(rise, F.lit(1.0)) * 20).cast("int")
    caps = F.create_map(*[F.lit(x) for pair in CONFIDENCE_CAPS.items() for x in pair])
    return F.least(raw, F.coalesce(F.try_element_at(caps, method), F.lit(100))).cast("int")


def selected(gates: DataFrame, group: str, mode: str, fs: Column) -> DataFrame:
    """Method, factor, passes, elbow distance, rise and confidence of each group: flat terrain (the national default of the functional system fs, of the group), elbow of three passes or more, highest safe, fallback 100."""
    own = gates.withColumn("_fs", fs)
    g = own.groupBy(group).agg(F.min("_fs").alias("_fs"), (F.max("rmse") - F.min("rmse")).alias("range"), F.count_if("passed").alias("passes"), F.max(F.when(F.col("passed"), F.col("factor"))).alias("highest"))
    e = elbow(gates.where("passed"), group).select(group, F.col("factor").alias("bend"), F.col("peak").alias("_peak"), F.col("rise").alias("_rise"))
    j = g.join(e, group, "left")
    flat = (F.lit(mode) == "V") & (F.col("range") < FLAT_TERRAIN_FT)
    method = F.when(flat, "flat_terrain_default").when(F.col("passes") >= 3, "elbow").when(F.col("passes") > 0, "highest_safe").otherwise("composite_fallback")
    default = by_system(V_SPLINE if mode == "V" else H_SPLINE, F.col("_fs"))
    factor = F.when(flat, default).when(F.col("passes") >= 3, F.col("bend")).when(F.col("passes") > 0, F.col("highest")).otherwise(100)
    bent = ~flat & (F.col("passes") >= 3)
    peak = F.when(bent, F.col("_peak")).otherwise(0.0)
    rise = F.when(F.col("passes") >= 2, F.col("_rise")).otherwise(0.0)
    out = j.select(group, method.alias("method"), factor.cast("int").alias("factor"), "passes", F.round(peak, 6).alias("peak"), F.round(rise, 6).alias("rise"))
    return out.withColumn("confidence", confidence(F.col("method"), F.col("peak"), F.col("passes"), F.col("rise")))


def audit_rows(gates: DataFrame, group: str, mode: str, fs: Column) -> DataFrame:
    """One audit row a group of a calibration sweep that has ended early where it may: what was chosen, and the metrics at the baseline, at the choice and at the last factor that passed.

    The baseline is factor 100, or the first one tried; proximity is the RMSE at the choice against its ceiling, in per
    cent; a factor that wasn't tried has no metrics.
    """
    choice = selected(gates, group, mode, fs)
    tried = gates.withColumn("_fs", fs).groupBy(group).agg(
        F.min("_fs").alias("f_system"), F.count("*").alias("n_evaluated"), F.min("factor").alias("_first"), F.bool_or(F.col("factor") == 100).alias("_base"), F.max(F.when(F.col("passed"), F.col("factor"))).cast("int").alias("last_passing"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("passed"), F.col("factor")))), "|").alias("passing_factors"), F.map_from_entries(F.collect_list(F.struct("factor", F.struct("rmse", "dev_p80")))).alias("_at"),
    )
    j = tried.join(choice, group)
    base = F.when(F.col("_base"), 100).otherwise(F.col("_first"))
    metric = lambda factor, name, out: F.round(F.try_element_at("_at", factor)[name], 4).alias(out)
    ceiling = by_system(V_RMSE_CEILING_FT if mode == "V" else H_RMSE_CEILING_FT, F.col("f_system"))
    default = by_system(V_SPLINE if mode == "V" else H_SPLINE, F.col("f_system"))
    got = F.round(F.try_element_at("_at", F.col("factor"))["rmse"], 4)
    return j.select(
        group, "f_system", F.lit(mode).alias("mode"), "n_evaluated", F.col("passes").alias("n_passing"), "passing_factors", F.round("rise", 4).alias("rmse_rise"), F.col("method").alias("selection_method"), F.col("factor").alias("selected_factor"), F.round("peak", 4).alias("peak_elbow_distance"),
        metric(base, "rmse", "rmse_at_baseline"), metric(base, "dev_p80", "dev_at_baseline"), metric(F.col("factor"), "rmse", "rmse_at_selected"), metric(F.col("factor"), "dev_p80", "dev_at_selected"), "last_passing", metric(F.col("last_passing"), "rmse", "rmse_at_last_passing"), metric(F.col("last_passing"), "dev_p80", "dev_at_last_passing"),
        default.cast("int").alias("national_default"), F.round(F.col("factor") / default, 3).alias("deviation_from_default"), F.round(got / ceiling * 100, 1).alias("ceiling_proximity_pct"), F.col("confidence").alias("confidence_score"), (~F.col("method").isin("elbow", "flat_curve")).alias("override_recommended"),
    )


#: Metrics of chunks put together, by their names in audit rows.
JOINT = ("v_rmse", "h_rmse", "maxv", "maxh", "curvevar", "std_v_rmse", "std_h_rmse")


def collated_joint(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks (v_rmse, h_rmse, max_v_dev, max_h_dev, curve_var) of a factor put together: means, 80th percentiles of deviations, population deviations; three chunks at least."""
    mean, far, spread = (lambda c: F.avg(c)), (lambda c: F.percentile(c, F.lit(0.8))), (lambda c: F.stddev_pop(c))
    made = zip((mean, mean, far, far, mean, spread, spread), ("v_rmse", "h_rmse", "max_v_dev", "max_h_dev", "curve_var", "v_rmse", "h_rmse"), JOINT, strict=True)
    return chunks.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(f(c), 6).alias(name) for f, c, name in made]).where("n >= 3")


def of_mode(joint: DataFrame, mode: str) -> DataFrame:
    """Joint metrics with rmse and dev_p80 of a mode, by which gates and choices go."""
    return joint.withColumns({"rmse": F.col("h_rmse" if mode == "H" else "v_rmse"), "dev_p80": F.col("maxh" if mode == "H" else "maxv")})


def audit_table(joint: DataFrame, group: str, mode: str, fs: Column, mountain: Column) -> DataFrame:
    """One row a group (its column, and AUDIT_COLUMNS but for timestamp, state and numbers of chunks) of a sweep's joint metrics: gates, early exit, choice, and all metrics at the baseline, the choice and the last factor that passed.

    The baseline is factor 100, or the first one tried. What doesn't exist, as the metrics of a factor that wasn't tried,
    is null. Proximity is the mode's RMSE at the choice against its ceiling, in per cent.
    """
    metrics = of_mode(joint, mode)
    tried = early_exit(gated(metrics, mode, fs, mountain), group)
    choice = selected(tried.join(metrics.select(group, "factor", fs.alias("_fs")), [group, "factor"]), group, mode, F.col("_fs"))
    all_of = tried.join(metrics.select(group, "factor", fs.alias("_fs"), *JOINT), [group, "factor"])
    got = all_of.groupBy(group).agg(
        F.min("_fs").alias("f_sys"), F.count("*").alias("n_evaluated"), F.min("factor").alias("_first"), F.bool_or(F.col("factor") == 100).alias("_base"), F.max(F.when(F.col("passed"), F.col("factor"))).cast("int").alias("last_passing_factor"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("passed"), F.col("factor")))), "|").alias("passing_factors"), F.map_from_entries(F.collect_list(F.struct("factor", F.struct(*JOINT)))).alias("_at"),
    )
    each = F.transform(F.array_sort(F.collect_list(F.struct("factor", "dist"))), lambda x: F.format_string("F%d:%.4f", x["factor"], x["dist"]))
    bends = chord_distances(tried.where("passed"), group).groupBy(group).agg(F.array_join(each, "  ").alias("_profile"))
    j = got.join(choice, group).join(bends, group, "left")
    f = F.col("f_sys")
    base = F.when(F.col("_base"), 100).otherwise(F.col("_first"))
    at = lambda factor, where, names: {f"{c}_at_{where}": F.round(F.try_element_at("_at", factor)[c], 4) for c in names}
    default = by_system(V_SPLINE if mode == "V" else H_SPLINE, f)
    ceilings = {"v_rmse_ceiling": by_system(V_RMSE_CEILING_FT, f), "h_rmse_ceiling": by_system(H_RMSE_CEILING_FT, f), "maxv_ceiling": by_system(V_DEVIATION_FT, f) + F.when(mountain, MOUNTAIN_EXTRA_FT).otherwise(0.0), "maxh_ceiling": by_system(H_DEVIATION_FT, f)}
    j = j.withColumns({**ceilings, **at(base, "baseline", JOINT[:5]), **at(F.col("factor"), "selected", JOINT), **at(F.col("last_passing_factor"), "last_passing", JOINT[:4])})
    own = F.col("h_rmse_at_selected") / F.col("h_rmse_ceiling") if mode == "H" else F.col("v_rmse_at_selected") / F.col("v_rmse_ceiling")
    j = j.withColumns({
        "mode": F.lit(mode), "is_mountain_state": mountain, "n_passing": F.col("passes"), "rmse_rise": F.round("rise", 4), "early_exit_factor": F.col("last_passing_factor"), "selection_method": F.col("method"), "selected_factor": F.col("factor"),
        "peak_elbow_distance": F.round("peak", 4), "elbow_distance_profile": F.when(F.col("method") == "elbow", F.col("_profile")), "national_default_factor": default.cast("int"), "deviation_from_default": F.round(F.col("factor") / default, 3),
        "ceiling_proximity_pct": F.round(own * 100, 1), "confidence_score": F.col("confidence"), "override_recommended": ~F.col("method").isin("elbow", "flat_curve"),
    })
    return j.select(group, *[c for c in AUDIT_COLUMNS if c in j.columns])


def composite_score(fs: Column, mountain: Column) -> Column:
    """How bad a factor is that no ceiling lets pass, of rows (v_rmse, h_rmse, v_dev, h_dev, curve_var): turning, squared drift, and a heavy penalty for what is beyond each ceiling."""
    v_ceiling, h_ceiling = by_system(V_RMSE_CEILING_FT, fs), by_system(H_RMSE_CEILING_FT, fs)
    beyond = [F.greatest(F.col(c) - limit, F.lit(0.0)) for c, limit in (("v_rmse", v_ceiling), ("h_rmse", h_ceiling), ("v_dev", by_system(V_DEVIATION_FT, fs) + F.when(mountain, MOUNTAIN_EXTRA_FT).otherwise(0.0)), ("h_dev", by_system(H_DEVIATION_FT, fs)))]
    drift = F.pow(F.col("v_rmse") / v_ceiling, 2) * 20 + F.pow(F.col("h_rmse") / h_ceiling, 2) * 20
    return F.col("curve_var") / CURVE_VARIATION * 100 + drift + 500 * sum(beyond[1:], beyond[0])


def selected_composite(gates: DataFrame, group: str) -> DataFrame:
    """The earlier rule of choice, of gates with a score: passing factors whose RMSE rises by less than ELBOW_FLAT_FT take the lowest, three passes the elbow, any pass the highest; without one the least score counts."""
    best = lambda c: F.when(F.col("passed"), F.col(c))
    g = gates.groupBy(group).agg(
        F.count_if("passed").alias("passes"), F.min(best("factor")).alias("lowest"), F.max(best("factor")).alias("highest"),
        (F.max(F.when(F.col("passed"), F.struct("factor", "rmse")))["rmse"] - F.min(F.when(F.col("passed"), F.struct("factor", "rmse")))["rmse"]).alias("climb"), F.min(F.struct(F.round("score", 6).alias("score"), "factor"))["factor"].alias("composite"),
    )
    e = elbow(gates.where("passed"), group).select(group, F.col("factor").alias("bend"))
    j = g.join(e, group, "left")
    flat = (F.col("passes") >= 3) & (F.col("climb") < ELBOW_FLAT_FT)
    method = F.when(flat, "flat_curve").when(F.col("passes") >= 3, "elbow").when(F.col("passes") > 0, "highest_safe").otherwise("composite_fallback")
    factor = F.when(flat, F.col("lowest")).when(F.col("passes") >= 3, F.col("bend")).when(F.col("passes") > 0, F.col("highest")).otherwise(F.col("composite"))
    return j.select(group, method.alias("method"), factor.cast("int").alias("factor"), "passes")


def deviations(vertices: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Metrics of each chunk of vertices (lon, lat, z as read and lon_s, lat_s, z_s as smoothed, metres and degrees): RMSE and largest deviation up and sideways in feet, and the mean turn of heading in degrees."""
    w = Window.partitionBy(*by).orderBy(*order)
    v = F.abs(F.col("z") - F.col("zs")) * FEET_PER_METER
    h = F.sqrt(F.pow((F.col("lat") - F.col("lat_s")) * DEGREE_FT, 2) + F.pow((F.col("lon") - F.col("lon_s")) * DEGREE_FT * F.cos(F.radians("lat_s")), 2))
    head = F.degrees(F.atan2(F.lead("lat_s").over(w) - F.col("lat_s"), F.lead("lon_s").over(w) - F.col("lon_s")))
    q = vertices.select(*by, *order, v.alias("v"), h.alias("h"), head.alias("head"))
    turn = F.abs(F.pmod(F.col("head") - F.lag("head").over(w) + 180, F.lit(360.0)) - 180)
    q = q.withColumn("turn", turn)
    return q.groupBy(*by).agg(
        F.round(F.sqrt(F.avg(F.col("v") * F.col("v"))), 6).alias("v_rmse"), F.round(F.sqrt(F.avg(F.col("h") * F.col("h"))), 4).alias("h_rmse"), F.round(F.max("v"), 6).alias("max_v_dev"), F.round(F.max("h"), 4).alias("max_h_dev"), F.round(F.avg("turn"), 4).alias("curve_var"),
    )


def sensitivity(vertices: DataFrame, factor: str, chunk: list[str], order: str, spacing: float) -> DataFrame:
    """For each factor the mean over its chunks of: population variance of curvature and of grade, RMSE and largest deviation in feet.

    vertices hold heading (degrees, unwrapped), z (as read) and zs (smoothed), in metres, `spacing` metres apart.
    """
    w = Window.partitionBy(factor, *chunk).orderBy(order)
    dev = F.abs(F.col("z") - F.col("zs"))
    q = vertices.select(factor, *chunk, dev.alias("dev"), (F.radians(F.lead("heading").over(w) - F.col("heading")) / spacing).alias("k"), ((F.lead("zs").over(w) - F.col("zs")) / spacing).alias("g"))
    by = q.groupBy(factor, *chunk).agg(F.var_pop("k").alias("k"), (F.sqrt(F.avg(F.col("dev") * F.col("dev"))) * FEET_PER_METER).alias("rmse"), (F.max("dev") * FEET_PER_METER).alias("most"), F.var_pop("g").alias("g"))
    return by.groupBy(factor).agg(F.round(F.avg("k"), 9).alias("h_variance"), F.round(F.avg("rmse"), 6).alias("v_rmse"), F.round(F.avg("most"), 6).alias("v_max"), F.round(F.avg("g"), 6).alias("v_variance"))


def sample_size(population: Column) -> Column:
    """Cochran's sample size at 95 % and 5 %, for a finite population, no more than it."""
    n0 = 1.96**2 * 0.25 / 0.05**2
    return F.least(F.ceil(F.lit(n0) / (1 + F.lit(n0 - 1) / population)), population).cast("long")


def method_breakdown(audit: DataFrame) -> DataFrame:
    """Methods of each functional system and mode, share of fallbacks and its flag."""
    g = audit.groupBy("f_system", "mode").agg(F.count("*").alias("n"), *[F.count_if(F.col("method") == m).alias(m) for m in ("elbow", "highest_safe", "flat_terrain_default", "composite_fallback")])
    rate = F.col("composite_fallback") / F.col("n")
    return g.withColumn("fallback_rate", F.round(rate, 6)).withColumn("flag", F.when(rate >= FALLBACK_ALERT, "ALERT").when(rate >= FALLBACK_WARN, "WARN").otherwise("OK"))


def ceiling_proximity(audit: DataFrame) -> DataFrame:
    """Mean and median proximity to the ceiling, share near it, and its flag."""
    near = F.avg((F.col("proximity") >= NEAR_CEILING_PCT).cast("double")) * 100
    g = audit.groupBy("f_system", "mode").agg(F.round(F.avg("proximity"), 6).alias("mean"), F.round(F.percentile("proximity", F.lit(0.5)), 6).alias("median"), F.round(near, 6).alias("near_pct"))
    return g.withColumn("flag", F.when(F.col("near_pct") >= 50, "ALERT").when(F.col("near_pct") >= 25, "WARN").otherwise("OK"))


def confidence_distribution(audit: DataFrame) -> DataFrame:
    """Confidence of elbows: mean, least, share of weak ones, and its flag."""
    weak = F.avg((F.col("confidence") < WEAK_CONFIDENCE).cast("double")) * 100
    g = audit.where("method = 'elbow'").groupBy("f_system", "mode").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.min("confidence").alias("least"), F.round(weak, 6).alias("weak_pct"))
    return g.withColumn("flag", F.when(F.col("weak_pct") >= 40, "ALERT").when(F.col("weak_pct") >= 20, "WARN").otherwise("OK"))


def factor_stability(audit: DataFrame) -> DataFrame:
    """Spread of the factors of two states or more, with the states beyond two deviations of the mean, in order."""
    w = Window.partitionBy("f_system", "mode")
    m, s = F.avg("factor").over(w), F.stddev_samp("factor").over(w)
    a = audit.withColumn("m", m).withColumn("s", s).withColumn("out", F.when(F.abs(F.col("factor") - F.col("m")) > 2 * F.col("s"), F.concat_ws(":", "state", "flag")))
    g = a.groupBy("f_system", "mode").agg(F.count("*").alias("n"), F.round(F.avg("factor"), 6).alias("mean"), F.round(F.stddev_samp("factor"), 6).alias("sd"), F.round(F.stddev_samp("factor") / F.avg("factor") * 100, 6).alias("cv_pct"), F.min("factor").alias("least"), F.max("factor").alias("most"), F.array_join(F.array_sort(F.collect_list("out")), ",").alias("outliers"))
    return g.where("n >= 2")


def verdict(audit: DataFrame) -> DataFrame:
    """Whether a functional system's thresholds look too tight or too loose, from fallbacks, proximity and weak elbows."""
    tight = (F.when(F.col("fallback") >= FALLBACK_ALERT, 2).when(F.col("fallback") >= FALLBACK_WARN, 1).otherwise(0)) + F.when(F.col("near") >= 50, 2).when(F.col("near") >= 25, 1).otherwise(0)
    loose = F.when(F.col("prox") < 40, 1).otherwise(0) + F.when(F.col("weak") >= 40, 1).otherwise(0)
    g = audit.groupBy("f_system").agg(
        F.avg((F.col("method") == "composite_fallback").cast("double")).alias("fallback"), (F.avg((F.col("proximity") >= NEAR_CEILING_PCT).cast("double")) * 100).alias("near"), F.avg("proximity").alias("prox"),
        F.coalesce(F.avg(F.when(F.col("method") == "elbow", (F.col("confidence") < WEAK_CONFIDENCE).cast("double"))) * 100, F.lit(0.0)).alias("weak"),
    )
    s = g.withColumn("tight", tight).withColumn("loose", loose)
    name = F.when((F.col("tight") >= 2) & (F.col("tight") > F.col("loose")), "TOO TIGHT").when((F.col("loose") >= 2) & (F.col("loose") > F.col("tight")), "TOO LOOSE").when((F.col("tight") + F.col("loose")) > 0, "REVIEW").otherwise("OK")
    return s.select("f_system", "tight", "loose", name.alias("verdict"))
