"""Joins of milepost intervals: overlap, point in interval, worst class, apportioned length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bucket is this many times as long as an interval of the longer side is on average: few lie in several, and few pairs of a bucket don't meet.
SPAN = 4.0


def _buckets(start: Column, end: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(F.least(start, end) / size), F.floor(F.greatest(start, end) / size)))


def bucket_of(*sides: tuple[DataFrame, str, str]) -> float:
    """Mileposts of a bucket for joining tables by their intervals (start, end): from their mean lengths, by one aggregate each."""
    means = [t.agg(F.avg(F.abs(F.col(e) - F.col(s)))).first()[0] or 0.0 for t, s, e in sides]
    return max(SPAN * max(means), 1e-3)


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re: str, size: float | None = None) -> DataFrame:
    """Pairs of rows with equal keys whose open intervals overlap, each pair once.

    The route alone is a skewed key, so both sides get the buckets they touch as a further key; a pair that meets in
    several is kept in the one where its overlap begins. Columns of the two sides must differ but for the keys.
    """
    size = size or bucket_of((left, ls, le), (right, rs, re))
    a = left.withColumn("_b", _buckets(F.col(ls), F.col(le), size))
    b = right.withColumn("_b", _buckets(F.col(rs), F.col(re), size))
    own = F.col("_b") == F.floor(F.greatest(F.col(ls), F.col(rs)) / size)
    return a.join(b, [*keys, "_b"]).where((F.col(le) > F.col(rs)) & (F.col(ls) < F.col(re)) & own).drop("_b")


def worst_bin(sections: DataFrame, curves: DataFrame, key: list[str], bin_column: str, out: str, size: float | None = None) -> DataFrame:
    """Each section with the worst class of the curves that it overlaps on its route, A if there are none."""
    return worst_bins(sections, curves, key, {bin_column: out}, size)


def worst_bins(sections: DataFrame, curves: DataFrame, key: list[str], bins: dict[str, str], size: float | None = None) -> DataFrame:
    """Each section with the worst class, in several columns of the curves (null where a curve has none), of those that it overlaps on its route; A if there are none."""
    size = size or bucket_of((sections, "start_mp", "end_mp"), (curves, "c_start", "c_end"))
    a = sections.withColumn("_b", _buckets(F.col("start_mp"), F.col("end_mp"), size))
    b = curves.select("route_id", F.col("c_start").alias("_cs"), F.col("c_end").alias("_ce"), *[F.col(c).alias(f"_bin{k}") for k, c in enumerate(bins)]).withColumn("_b", _buckets(F.col("_cs"), F.col("_ce"), size))
    hit = a.join(b, ["route_id", "_b"], "left")
    meet = (F.col("end_mp") > F.col("_cs")) & (F.col("start_mp") < F.col("_ce"))
    worst = [F.coalesce(F.max(F.when(meet, F.col(f"_bin{k}"))), F.lit("A")).alias(out) for k, out in enumerate(bins.values())]
    return hit.groupBy("route_id", *key, "start_mp", "end_mp").agg(*worst)


def holding(intervals: DataFrame, points: DataFrame, key: str, s: str, e: str, at: str, size: float | None = None) -> DataFrame:
    """Distinct intervals (key, s, e) that hold a point of their key, both ends included."""
    size = size or bucket_of((intervals, s, e))
    a = intervals.select(key, s, e).withColumn("_b", _buckets(F.col(s), F.col(e), size))
    b = points.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.floor(F.col(at) / size).alias("_c"))
    return a.join(b, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")) & F.col("_at").between(F.col(s), F.col(e)), "left_semi").select(key, s, e).distinct()


def apportioned(sections: DataFrame, curves: DataFrame, key: list[str], bin_column: str) -> DataFrame:
    """Length of each section in classes B to F by overlap; A has what is left, 0 at least."""
    pairs = overlap_pairs(sections, curves.where(F.col(bin_column) != "A"), ["route_id"], "start_mp", "end_mp", "c_start", "c_end")
    share = F.greatest(F.least("end_mp", "c_end") - F.greatest("start_mp", "c_start"), F.lit(0.0))
    sums = pairs.groupBy(*key).agg(*[F.sum(F.when(F.col(bin_column) == x, share)).alias(f"_{x}") for x in "BCDEF"])
    joined = sections.join(sums, key, "left")
    parts = {x: F.coalesce(F.col(f"_{x}"), F.lit(0.0)) for x in "BCDEF"}
    rest = F.greatest(F.col("end_mp") - F.col("start_mp") - sum(parts.values(), F.lit(0.0)), F.lit(0.0))
    return joined.select(*key, F.round(rest, 6).alias("len_a"), *[F.round(v, 6).alias(f"len_{k.lower()}") for k, v in parts.items()])


def point_in_interval(points: DataFrame, intervals: DataFrame, at: str, s: str, e: str, order: str, value: str, point_key: list[str], skip_null: bool = False, size: float | None = None) -> DataFrame:
    """Each point with the value of the last interval, in `order`, of its route that holds it, both ends included.

    With skip_null, intervals without a value don't overwrite earlier ones. Points in none get null.
    """
    size = size or bucket_of((intervals, s, e))
    b = intervals.select("route_id", F.col(s).alias("_s"), F.col(e).alias("_e"), F.col(order).alias("_o"), F.col(value).alias("_v")).where("_s <= _e")
    b = b.where("_v is not null") if skip_null else b
    b = b.withColumn("_b", _buckets(F.col("_s"), F.col("_e"), size))
    a = points.withColumn("_b", F.floor(F.col(at) / size))
    inside = (F.col(at) >= F.col("_s")) & (F.col(at) <= F.col("_e"))
    last = F.max(F.when(inside, F.struct("_o", "_v")))["_v"]
    return a.join(b, ["route_id", "_b"], "left").groupBy("route_id", *point_key, at).agg(last.alias(value))


def on_structures(points: DataFrame, sections: DataFrame, at: str, point_key: list[str]) -> DataFrame:
    """Points (route_id, at, point_key) with on_structure: whether they lie, ends included, in a section of their route with structure type 1 or 2 and rising mileposts."""
    known = sections.where("structure_type in (1, 2) and start_mp < end_mp").withColumn("_any", F.lit(1))
    got = point_in_interval(points, known, at, "start_mp", "end_mp", "_any", "_any", point_key)
    return got.withColumn("on_structure", F.col("_any").isNotNull()).drop("_any")
