"""Joins by distance: grid cells as equality keys, the exact distance after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import AT_GRADE_FT, GRADE_SEPARATED_FT, VOID_M
from ..functions.classify import topology
from ..functions.geo import tile_name
from ..storage import new_folder, written

#: Left points of a cell that meet its right points in one task.
SLICE = 4096
#: Feet of elevation that the nodes of a box span at most.
BAND_FT = 2.5


def _cells(df: DataFrame, x: str, y: str, size: float, around: bool) -> DataFrame:
    """Integer cell of each point, or the nine cells about it."""
    cx, cy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not around:
        return df.withColumn("_cx", cx).withColumn("_cy", cy)
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumn("_cx", cx + F.col("_dx")).withColumn("_cy", cy + F.col("_dy")).drop("_dx", "_dy")


def within(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, radius: float, how: str = "inner") -> DataFrame:
    """Pairs of points at `radius` or less (how='inner', with their distance as dist), or the left points that have one ('left_semi').

    Each cell is as wide as the radius; the right side is copied to nine cells, the left is not. Column names must differ.
    For 'left_semi' each place of the right side counts once.
    """
    right = right.select(rx, ry).distinct() if how == "left_semi" else right
    a, b = _cells(left, lx, ly, radius, False), _cells(right, rx, ry, radius, True)
    d = F.sqrt(F.pow(F.col(lx) - F.col(rx), 2) + F.pow(F.col(ly) - F.col(ry), 2))
    if how == "left_semi":
        b = b.withColumnsRenamed({"_cx": "_rx", "_cy": "_ry"})
        return a.join(b, (F.col("_cx") == F.col("_rx")) & (F.col("_cy") == F.col("_ry")) & (d <= radius), "left_semi").drop("_cx", "_cy")
    return a.join(b, ["_cx", "_cy"]).withColumn("dist", d).where(F.col("dist") <= radius).drop("_cx", "_cy")


def within_dense(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, radius: float, slices_of: int = SLICE) -> DataFrame:
    """As `within`, where a cell may hold any share of all points: the left points of a cell of more than slices_of are dealt to slices, and its right points go to each of these.

    So a cell's pairs are spread over tasks, slices_of left points in each.
    """
    a, b = _cells(left, lx, ly, radius, False), _cells(right, rx, ry, radius, True)
    many = a.groupBy("_cx", "_cy").agg(F.ceil(F.count("*") / slices_of).alias("_n")).where("_n > 1")
    a = a.join(many, ["_cx", "_cy"], "left").withColumn("_slice", F.coalesce(F.pmod(F.xxhash64(*left.columns), "_n"), F.lit(0))).drop("_n")
    b = b.join(many, ["_cx", "_cy"], "left").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    d = F.sqrt(F.pow(F.col(lx) - F.col(rx), 2) + F.pow(F.col(ly) - F.col(ry), 2))
    return a.join(b, ["_cx", "_cy", "_slice"]).withColumn("dist", d).where(F.col("dist") <= radius).drop("_cx", "_cy", "_slice")


def nearest(left: DataFrame, right: DataFrame, key: str, other: str, lx: str, ly: str, rx: str, ry: str, radius: float) -> DataFrame:
    """Each left point's nearest right point at `radius` or less, ties to the smaller id.

    Places meet, not points: of right points at one place only the smallest id can be the nearest, and left points at one
    place share theirs. So copies on either side make no more pairs.
    """
    near = lambda: F.min(F.struct(F.round("dist", 9).alias("d"), F.col(other).alias("o"))).alias("b")
    pairs = within(left.select(lx, ly).distinct(), right.groupBy(rx, ry).agg(F.min(other).alias(other)), lx, ly, rx, ry, radius)
    best = left.select(key, lx, ly).join(pairs.groupBy(lx, ly).agg(near()), [lx, ly]).groupBy(key).agg(F.min("b").alias("b"))
    return best.select(key, F.col("b.o").alias(other), F.round("b.d", 6).alias("dist"))


def sampled(points: DataFrame, raster: DataFrame, lon: str, lat: str, out: str, per_degree: int = 2400) -> DataFrame:
    """points with the raster's elevation in the cell that each lies in; null where the tile has none, or holds a void (below VOID_M).

    raster has one row a cell: tile (of one degree, by name), row from its northern edge, column from its western edge, z.
    """
    west, north = F.floor(F.col(lon)), F.floor(F.col(lat)) + 1
    at = {"_tile": tile_name(F.col(lon), F.col(lat)), "_row": F.least(F.floor((north - F.col(lat)) * per_degree), F.lit(per_degree - 1)).cast("int"), "_col": F.floor((F.col(lon) - west) * per_degree).cast("int")}
    r = raster.select(F.col("tile").alias("_tile"), F.col("row").cast("int").alias("_row"), F.col("col").cast("int").alias("_col"), F.when(F.col("z") >= VOID_M, F.col("z")).alias(out))
    return points.withColumns(at).join(r, ["_tile", "_row", "_col"], "left").drop("_tile", "_row", "_col")


def stitch_ordered(lines: DataFrame, key: str, order: str, points: str, snap: float = 1e-6) -> DataFrame:
    """Lines of each key in their order, joined where one begins within snap of the end of the one before: (key, chain, pieces, points).

    points is an array of struct<x, y>; empty ones are passed over, and a chain of a single point is left out.
    """
    w = Window.partitionBy(key).orderBy(order)
    some = lines.where(F.size(points) > 0).select(key, order, F.col(points).alias("_p"))
    end, begin = F.lag(F.element_at("_p", -1)).over(w), F.col("_p")[0]
    apart = F.coalesce(F.sqrt(F.pow(begin["x"] - end["x"], 2) + F.pow(begin["y"] - end["y"], 2)) >= snap, F.lit(True))
    part = some.withColumn("_new", apart).withColumn("chain", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.when(F.col("_new"), F.col("_p")).otherwise(F.slice("_p", F.lit(2), F.size("_p")))
    g = part.withColumn("_own", own).groupBy(key, "chain").agg(F.count("*").alias("pieces"), F.array_sort(F.collect_list(F.struct(order, "_own"))).alias("_all"))
    return g.select(key, "chain", "pieces", F.flatten(F.transform("_all", lambda s: s["_own"])).alias("points")).where("size(points) >= 2")


def pages(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """points (x, y, mp) of each page turned about its first so that its last lies level with it, x rescaled to the page's mileposts; pages of one point are left out."""
    first, last = F.min(F.struct(order, "x", "y")), F.max(F.struct(order, "x", "y"))
    c = points.groupBy(*keys).agg(first.alias("_f"), last.alias("_l"), F.min("mp").alias("_m0"), F.max("mp").alias("_m1"), F.count("*").alias("_n")).where("_n >= 2")
    a = -F.atan2(F.col("_l.y") - F.col("_f.y"), F.col("_l.x") - F.col("_f.x"))
    dx, dy = F.col("x") - F.col("_f.x"), F.col("y") - F.col("_f.y")
    r = points.join(c.withColumn("_a", a), keys).withColumns({"_x": dx * F.cos("_a") - dy * F.sin("_a"), "_y": dx * F.sin("_a") + dy * F.cos("_a")})
    w = Window.partitionBy(*keys)
    x0, x1 = F.min("_x").over(w), F.max("_x").over(w)
    scaled = F.when(x1 > x0, F.col("_m0") + (F.col("_x") - x0) * (F.col("_m1") - F.col("_m0")) / (x1 - x0)).otherwise(F.col("_x"))
    return r.withColumn("_s", scaled).select(*keys, order, F.col("_s").alias("x"), F.col("_y").alias("y"), "mp")


def topology_pairs(nodes: DataFrame, radius: float, slices_of: int = SLICE) -> DataFrame:
    """Pairs of nodes of different routes at `radius` or less, the smaller id first, with their distance and the difference of elevations.

    Places meet, each two of them once, not nodes: the nodes of a place go over the shuffle as lists, one a route and slice
    of at most about slices_of, to the places near it, and pairs are only made from two lists that have met. So what is
    moved and held grows with the nodes, not with their pairs, and a place's pairs are spread over tasks by slices.
    """
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = nodes.select("node_id", "route_id", "lon", "lat", "elev").where("node_id is not null and route_id is not null").withColumn("_place", F.xxhash64("lon", "lat"))
    # A hash stands for a place, as joins on two doubles would shuffle once more; what it brings together is compared as well.
    same = lambda *pairs: " and ".join(f"{a} <= {b} and {a} >= {b}" for a, b in pairs)
    other = lambda df: df.withColumnsRenamed({"_place": "_o_place", **{c: f"o_{c}" for c in df.columns if c != "_place"}})
    places = n.select("_place", "lon", "lat").distinct()
    near = within(places, other(places), "lon", "lat", "o_lon", "o_lat", radius).where("lon < o_lon or lon = o_lon and lat <= o_lat")
    many = n.groupBy("_place").agg(F.ceil(F.count("*") / slices_of).alias("_n")).where("_n > 1")
    sliced = n.join(many, "_place", "left").withColumn("_slice", F.coalesce(F.pmod(F.xxhash64("node_id"), "_n"), F.lit(0)))
    lists = sliced.groupBy("_place", "lon", "lat", "route_id", "_slice").agg(F.collect_list(F.struct("node_id", "elev")).alias("nodes"))
    left = lists.withColumnsRenamed({"lon": "_lon", "lat": "_lat"}).join(near, "_place").where(same(("_lon", "lon"), ("_lat", "lat"))).drop("_place", "_lon", "_lat").repartition(tasks, "_o_place", "_slice")
    copies = near.join(many, "_place").groupBy("_o_place").agg(F.max("_n").alias("_n"))
    right = other(lists.drop("_slice")).withColumnsRenamed({"o_lon": "_lon", "o_lat": "_lat"}).join(copies, "_o_place", "left")
    right = right.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_n", F.lit(1)) - 1))).drop("_n").repartition(tasks, "_o_place", "_slice")
    # Lists of few rows are long: if they were broadcast, all nodes would go through the driver.
    met = left.join(right.hint("merge"), ["_o_place", "_slice"]).where(same(("_lon", "o_lon"), ("_lat", "o_lat")))
    met = met.where("route_id < o_route_id or route_id > o_route_id and (lon <> o_lon or lat <> o_lat)")
    pairs = met.withColumn("_a", F.explode("nodes")).drop("nodes").withColumn("_b", F.explode("o_nodes")).drop("o_nodes").where("_a.node_id <> _b.node_id")
    first = F.col("_a.node_id") < F.col("_b.node_id")
    own = {"node_id": ("_a.node_id", "_b.node_id"), "route_id": ("route_id", "o_route_id"), "lon": ("lon", "o_lon"), "lat": ("lat", "o_lat"), "elev": ("_a.elev", "_b.elev")}
    one = [F.when(first, F.col(a)).otherwise(F.col(b)).alias(c) for c, (a, b) in own.items()]
    other = [F.when(first, F.col(b)).otherwise(F.col(a)).alias(f"o_{c}") for c, (a, b) in own.items()]
    return pairs.select(*one, *other, "dist", F.abs(F.col("_a.elev") - F.col("_b.elev")).alias("dz"))


def first_pairs(nodes: DataFrame, radius: float, crossing: bool) -> DataFrame:
    """Of every two routes with nodes at `radius` or less the first pair of such nodes, by node_id, then o_node_id, with dz, the difference of elevations.

    With `crossing` node_id is of the lesser route and the two must make a crossing (`topology`); else node_id is the
    lesser of the two. Further columns of the nodes come along, those of the other with o_ before their names.

    Pairs are never all made: a few nodes of each small square and route give a pair, and only nodes up to the first of that
    pair are then held against the others. These lie in boxes (a small square, a route, a band of elevations), of which
    only those that may hold a partner are opened. Two routes without such a pair are left to the boxes alone.
    """
    small, least = radius / 2 * (1 + 1e-9), F.lit(-(2**62))
    square = {"_sx": F.floor(F.col("lon") / small), "_sy": F.floor(F.col("lat") / small), "_band": F.coalesce(F.floor(F.col("elev") / BAND_FT), least)}
    cell = {"_cx": F.floor(F.col("_sx") / 2), "_cy": F.floor(F.col("_sy") / 2)}
    kept = nodes.where("node_id is not null and route_id is not null" + (" and elev is not null" if crossing else ""))
    n = written(kept.withColumns(square).withColumns(cell), f"{new_folder(nodes.sparkSession, 'pairs')}/nodes")
    other = lambda df: df.withColumnsRenamed({c: f"o_{c}" for c in df.columns})
    around = lambda df: df.withColumn("_at", F.explode(F.array(*[F.struct((F.col("_cx") + i).alias("_cx"), (F.col("_cy") + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))).drop("_cx", "_cy").select("*", "_at.*").drop("_at")
    routes = F.col("route_id") < F.col("o_route_id") if crossing else F.col("route_id") != F.col("o_route_id")
    two = {"_lo": F.least("route_id", "o_route_id"), "_hi": F.greatest("route_id", "o_route_id")}
    dist = F.sqrt(F.pow(F.col("lon") - F.col("o_lon"), 2) + F.pow(F.col("lat") - F.col("o_lat"), 2))
    dz = F.abs(F.col("elev") - F.col("o_elev"))
    met = routes & (dist <= radius) & (topology(dz).isNotNull() if crossing else F.col("node_id") < F.col("o_node_id"))

    some = [f(F.struct(*c)) for f, c in ((F.min, ("node_id", "elev", "lon", "lat")), (F.min, ("elev", "node_id", "lon", "lat")), (F.max, ("elev", "node_id", "lon", "lat")))]
    alike = [F.struct(*[s[c].alias(c) for c in ("node_id", "elev", "lon", "lat")]) for s in some]
    few = n.groupBy("_cx", "_cy", "_sx", "_sy", "route_id").agg(F.array_distinct(F.array(*alike)).alias("_n")).select("_cx", "_cy", "route_id", F.inline("_n"))
    o_few = other(few).withColumnsRenamed({"o__cx": "_cx", "o__cy": "_cy"})
    bound = around(few).join(o_few, ["_cx", "_cy"]).where(met).withColumns(two).groupBy("_lo", "_hi").agg(F.min("node_id").alias("_most"))

    here = few.select("_cx", "_cy", "route_id").distinct()
    there = around(here).distinct().withColumnRenamed("route_id", "o_route_id")
    others = here.join(there, ["_cx", "_cy"]).where(routes).withColumns(two).join(bound, ["_lo", "_hi"], "left").groupBy("_cx", "_cy", "route_id").agg(F.collect_list(F.struct("o_route_id", "_most")).alias("_others"))
    early = F.filter("_others", lambda o: o["_most"].isNull() | (F.col("node_id") <= o["_most"]))
    a = n.drop("_sx", "_sy", "_band").join(others, ["_cx", "_cy", "route_id"]).withColumn("_others", early).where(F.size("_others") > 0)
    a = around(a.withColumn("o_route_id", F.explode("_others.o_route_id")).drop("_others"))

    boxes = n.groupBy("_cx", "_cy", "_sx", "_sy", "_band", F.col("route_id").alias("o_route_id")).agg(*[f(c).alias(f"{t}_{c}") for c in ("lon", "lat", "elev") for f, t in ((F.min, "_a"), (F.max, "_b"))])
    away = lambda c: F.greatest(F.col(f"_a_{c}") - F.col(c), F.col(c) - F.col(f"_b_{c}"), F.lit(0.0))
    may = F.sqrt(F.pow(away("lon"), 2) + F.pow(away("lat"), 2)) <= radius * (1 + 1e-12)
    if crossing:
        may &= (away("elev") <= AT_GRADE_FT) | (F.col("elev") - F.col("_a_elev") > GRADE_SEPARATED_FT) | (F.col("_b_elev") - F.col("elev") > GRADE_SEPARATED_FT)
    opened = a.join(boxes, ["_cx", "_cy", "o_route_id"]).where(may).select(*nodes.columns, "o_route_id", "_sx", "_sy", "_band")
    b = other(n.drop("_cx", "_cy")).withColumnsRenamed({f"o_{c}": c for c in square})
    pairs = opened.join(b, ["_sx", "_sy", "_band", "o_route_id"]).where(met).withColumn("dz", dz).withColumns(two)
    rest = [c for c in (*nodes.columns, *[f"o_{c}" for c in nodes.columns], "dz") if c not in ("node_id", "o_node_id")]
    return pairs.groupBy("_lo", "_hi").agg(F.min(F.struct("node_id", "o_node_id", *rest)).alias("_first")).select("_first.*")


def cells_of_segments(segments: DataFrame, x0: str, y0: str, x1: str, y1: str, size: float) -> DataFrame:
    """Each segment with every cell of a grid that it touches; the grid begins at the footprint's corner.

    Cells of the segment's box are enumerated and held against the line exactly, by the slab test.
    """
    box = segments.agg(F.min(F.least(x0, x1)).alias("_minx"), F.min(F.least(y0, y1)).alias("_miny"))
    s = segments.crossJoin(F.broadcast(box))  # one row
    span = lambda a, b, o: F.sequence(F.floor((F.least(a, b) - F.col(o)) / size), F.floor((F.greatest(a, b) - F.col(o)) / size))
    e = s.withColumn("gx", F.explode(span(x0, x1, "_minx"))).withColumn("gy", F.explode(span(y0, y1, "_miny")))
    lo_x, lo_y = F.col("_minx") + F.col("gx") * size, F.col("_miny") + F.col("gy") * size

    def slab(p: str, q: str, lo) -> tuple:
        d = F.col(q) - F.col(p)
        t0, t1 = (lo - F.col(p)) / d, (lo + size - F.col(p)) / d
        return F.when(d == 0, 0.0).otherwise(F.least(t0, t1)), F.when(d == 0, 1.0).otherwise(F.greatest(t0, t1))

    (ax, bx), (ay, by) = slab(x0, x1, lo_x), slab(y0, y1, lo_y)
    return e.where(F.greatest(ax, ay, F.lit(0.0)) <= F.least(bx, by, F.lit(1.0))).drop("_minx", "_miny")
