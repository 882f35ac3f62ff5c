"""The whole alignment flow over geographic sections: chains, smoothed plan and profile, structures, curves, scores.

Two kernels run on one chain's samples each (plan, then profile); what lies between and after them is joins and windows:
projection, raster elevations, structure tiers and clearances, curve tables, tags, scores, class lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BLIND_FT, CLEARANCE_RADIUS_DEG, DEGREE_FT, FEET_PER_METER, METERS_PER_MILE, STRUCTURE_RADIUS_M, TOPOLOGY_RADIUS_DEG, Params, smoothing_factor
from ..functions.classify import clearance_m, grade_bin, topology
from ..functions.geo import utm, utm_zone
from ..kernels import profile, projection, smooth
from ..operators import curves as C
from ..operators import intervals, spatial
from ..operators.attributes import attributes, interval
from ..operators.cleaning import route_clip
from ..storage import new_folder, removed, written
from .alignment import pieces, spread, stitch

PLAN = "path string, RouteId string, FSystem int, low double, high double, epsg int, idx int, dist_m double, spacing double, Milepost double, x_raw double, y_raw double, x double, y double, lon_raw double, lat_raw double, lon double, lat double, error string"
PROFILE = "path string, idx int, z_raw double, z double, tier int, heading double, grade double, roughness double, asd_ft double, error string"
TIERS = ("None", "1_HPMS", "2_NBI", "3_DIP")
#: Degrees within which a structure can be near a vertex at all: the radius in metres, at up to 70 degrees of latitude.
REACH_DEG = 5e-4
#: Vertices of a chain that a kernel returns at a time.
PIECE = 1 << 16


class Alignment:
    """What the flow gives, from its written tables of plan and vertices (release() deletes them).

    Curves are written too, each kind when it is first asked for: tags, scores and the widths of buckets read them several
    times. So who wants one kind of curves neither waits for the other nor for tags and scores.
    """

    def __init__(self, sections: DataFrame, plan: DataFrame, profile: DataFrame, p: Params, folder: str):
        self.sections, self.plan, self.profile, self.p, self.folder = sections, plan, profile, p, folder
        self._sound = profile.where("error is null").drop("error")

    @property
    def _paths(self) -> DataFrame:
        return self._sound.groupBy("path").agg(F.first("RouteId").alias("RouteId"), F.first("FSystem").alias("FSystem"), F.first("low").alias("low"), F.first("high").alias("high"), F.max("dist_m").alias("total_m"))

    @cached_property
    def horizontal(self) -> DataFrame:
        return written(horizontal(self._sound, self._paths, self.p), f"{self.folder}/horizontal")

    @cached_property
    def vertical(self) -> DataFrame:
        return written(vertical(self._sound, self._paths, self.p), f"{self.folder}/vertical")

    @cached_property
    def vertices(self) -> DataFrame:
        out = tagged(self._sound, self.sections, self.horizontal, self.vertical)
        return out.withColumn("Structure_Tier", F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1)).withColumn("Elev_Ft", F.col("z") * FEET_PER_METER)

    @cached_property
    def scores(self) -> DataFrame:
        return scored(self.sections, self.horizontal, self.vertical)

    @property
    def errors(self) -> DataFrame:
        return self.plan.where("error is not null").select("path", "error").unionByName(self.profile.where("error is not null").select("path", "error"))

    def release(self) -> None:
        removed(self.plan.sparkSession, self.folder)


def projected(chains: DataFrame) -> DataFrame:
    """Chains of degrees as chains of metres in the UTM zone of their first point, with its code; one row a chain, key `path`."""
    c = chains.withColumn("epsg", utm_zone(F.col("xs")[0], F.col("ys")[0])).withColumn("path", F.concat_ws("/", "RouteId", F.col("part_no").cast("string")))

    def metres(x, y):
        e, n = utm(x, y, F.col("epsg"))
        return F.struct(e.alias("x"), n.alias("y"))

    c = c.withColumn("_p", F.zip_with("xs", "ys", metres))
    return c.select("path", "RouteId", "FSystem", "low", "high", "epsg", F.transform("_p", lambda q: q["x"]).alias("xs"), F.transform("_p", lambda q: q["y"]).alias("ys"))


def planned(chains: DataFrame, p: Params) -> DataFrame:
    """Vertices of every chain at equal spacing, as read and smoothed (in metres, and in degrees lon_raw, lat_raw and lon, lat), with mileposts; a chain that is too short for the smoothing window gives one row with the error, index -1."""
    names = [c.split()[0] for c in PLAN.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (r,) = (r for pdf in frames for r in pdf.itertuples(index=False))
        head = {"path": r.path, "RouteId": r.RouteId, "FSystem": r.FSystem, "low": r.low, "high": r.high, "epsg": r.epsg}
        x, y = np.asarray(r.xs, float), np.asarray(r.ys, float)
        at = np.concatenate(([0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))))
        n = max(2, int(np.ceil(at[-1] / p.metres("densify_ft"))) + 1) if np.isfinite(at[-1]) else 0
        if n < max(p.savgol_window + 2, 8):
            yield pd.DataFrame([head | {"idx": -1, "error": "a coordinate is not a number" if not n else f"too few points ({n}) for the smoothing window"}], columns=names)
            return
        grid = np.linspace(0, at[-1], n)
        x, y = np.interp(grid, at, x), np.interp(grid, at, y)
        del grid
        step = float(np.hypot(np.diff(x), np.diff(y)).sum() / (n - 1))
        d = np.arange(n) * step
        s = smoothing_factor(p, "H", int(r.FSystem))
        xs, ys = smooth.smoothing_spline(d, x, s), smooth.smoothing_spline(d, y, s)
        for a, b in smooth.parts(n, PIECE):
            along = d[a:b]
            out = {"idx": np.arange(a, b, dtype=np.int32), "dist_m": along, "spacing": step, "Milepost": r.low + along / max(d[-1], 1e-9) * (r.high - r.low), "x_raw": x[a:b], "y_raw": y[a:b], "x": xs[a:b], "y": ys[a:b], "error": None}
            for end in ("_raw", ""):
                out[f"lon{end}"], out[f"lat{end}"] = projection.utm_inverse(out[f"x{end}"], out[f"y{end}"], int(r.epsg))
            yield pd.DataFrame(head | out, columns=names)

    return spread(chains, "path").groupBy("path").applyInPandas(run, PLAN)


def gathered(frames: Iterator[pd.DataFrame], kinds: dict[str, type]) -> tuple[dict, dict[str, np.ndarray]]:
    """A chain's first row, and idx and the named columns of all its rows in the order of idx, each of its kind. Arrays grow in place and frames are given up as they come, so a column is held once."""
    first, n, room = None, 0, PIECE
    held = {c: np.zeros(room, kind) for c, kind in {"idx": np.int32, **kinds}.items()}
    for pdf in frames:
        first = pdf.iloc[0].to_dict() if first is None else first
        if n + len(pdf) > room:
            room = max(n + len(pdf), room * 5 // 4)
            for whole in held.values():
                whole.resize(room, refcheck=False)
        for c, whole in held.items():
            whole[n : n + len(pdf)] = pdf[c].to_numpy()
        n += len(pdf)
    for whole in held.values():
        whole.resize(n, refcheck=False)
    if not (np.diff(held["idx"]) > 0).all():
        order = np.argsort(held["idx"], kind="stable").astype(np.int32)
        for c in held:
            held[c] = held[c][order]
    return first, held


def masked(vertices: DataFrame, sections: DataFrame, structures: DataFrame) -> DataFrame:
    """Vertices with known (0, 1 or 2) and clearance (metres, of bridges of tier 2).

    Tier 1 is a milepost within a section of structure type 1 or 2, tier 2 a structure of the inventory within
    STRUCTURE_RADIUS_M, in metres of the vertex's zone. The clearance is that of the nearest structure, in degrees, within
    CLEARANCE_RADIUS_DEG, ties to the smaller id. The inventory is copied to nine cells, the vertices never.
    """
    own = sections.select(F.col("RouteId").alias("route_id"), F.col("Structure_Type").alias("structure_type"), F.col("Start_MP").alias("start_mp"), F.col("End_MP").alias("end_mp"))
    at = vertices.select(F.col("RouteId").alias("route_id"), "path", "idx", "Milepost")
    one = intervals.on_structures(at, own, "Milepost", ["path", "idx"]).where("on_structure").select("path", "idx", F.lit(True).alias("_one"))
    s = structures.select("structure_id", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"), clearance_m(F.col("vertical_clearance")).alias("s_clear"))
    # Of structures at one place the smallest id would be taken in any case.
    s = s.groupBy("s_lon", "s_lat").agg(F.min(F.struct("structure_id", "s_clear")).alias("_s")).select("s_lon", "s_lat", "_s.*")
    pairs = spatial.within(vertices.select("path", "idx", "lon", "lat", "x", "y", "epsg"), s, "lon", "lat", "s_lon", "s_lat", REACH_DEG)
    e, n = utm(F.col("s_lon"), F.col("s_lat"), F.col("epsg"))
    metres = F.sqrt(F.pow(F.col("x") - e, 2) + F.pow(F.col("y") - n, 2))
    near = F.min(F.when(F.col("dist") <= CLEARANCE_RADIUS_DEG, F.struct("dist", "structure_id", "s_clear")))
    two = pairs.groupBy("path", "idx").agg(F.bool_or(metres <= STRUCTURE_RADIUS_M).alias("_two"), near["s_clear"].alias("_clear"))
    v = vertices.join(one, ["path", "idx"], "left").join(two, ["path", "idx"], "left")
    known = F.when(F.col("_one"), 1).when(F.col("_two"), 2).otherwise(0)
    return v.withColumn("known", known).withColumn("clearance", F.when(known == 2, F.col("_clear"))).drop("_one", "_two", "_clear")


def profiled(vertices: DataFrame, p: Params) -> DataFrame:
    """Profile of every chain of vertices (path, idx, FSystem, spacing, x, y, z_read, known, clearance); a chain without any elevation gives one row with the error, index -1."""
    names = [c.split()[0] for c in PROFILE.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, v = gathered(frames, {"z_read": float, "known": np.int8, "clearance": float, "x": float, "y": float})
        path, step = first["path"], float(first["spacing"])
        read, known, idx = v.pop("z_read"), v.pop("known"), v.pop("idx")
        if not np.isfinite(read).any():
            yield pd.DataFrame([{"path": path, "idx": -1, "error": "no elevation is known along the chain"}], columns=names)
            return
        head = np.degrees(np.arctan2(np.diff(v.pop("y")), np.diff(v.pop("x"))))
        head = smooth.savgol(smooth.unwrapped(np.append(head, head[-1])), p.savgol_window)
        ground = smooth.filled(read)
        del read
        fixed, tier = profile.repair_dips(ground, profile.trend_of(ground, known, step, p), known, step, p)
        fixed = np.where(tier == 2, profile.anchored(fixed, ground, v.pop("clearance")), fixed)
        z = smooth.smoothing_spline(idx * step, fixed, smoothing_factor(p, "V", int(first["FSystem"])))
        del fixed
        rough = smooth.roughness(ground - z, step)
        for a, b in smooth.parts(len(z), PIECE):
            grade, asd = profile.along(z, step, p.metres("regression_ft"), a, b)
            yield pd.DataFrame({"path": path, "idx": idx[a:b], "z_raw": ground[a:b], "z": z[a:b], "tier": tier[a:b], "heading": head[a:b], "grade": grade, "roughness": rough[a:b], "asd_ft": asd, "error": None}, columns=names)

    return spread(vertices.select("path", "idx", "FSystem", "spacing", "x", "y", "z_read", "known", "clearance"), "path").groupBy("path").applyInPandas(run, PROFILE)


def calibrated(curves: DataFrame, paths: DataFrame) -> DataFrame:
    """Curves with their route, part, functional system and mileposts: start and end as shares of the path's length."""
    share = lambda c: F.col("low") + F.col(c) / F.greatest("total_m", F.lit(1.0)) * (F.col("high") - F.col("low"))
    return curves.join(paths, "path").withColumns({"start_mp": share("start_dist"), "end_mp": share("end_dist")}).withColumnRenamed("low", "Part").drop("high", "total_m")


def horizontal(vertices: DataFrame, paths: DataFrame, p: Params) -> DataFrame:
    """Horizontal curves of all chains, merged where the parameters say so, with geometry."""
    h = C.headings(C.curvature(vertices.select("path", "idx", "x", "y", "lon", "lat", "spacing"), "path", "idx", step="spacing"), "path", "idx")
    c = C.horizontal_curves(h, p, "path", "idx", "spacing").withColumn("merge_status", F.lit("Simple"))
    if p.merge:
        rows = c.select("path", F.row_number().over(Window.partitionBy("path").orderBy("start_dist")).alias("curve_id"), (F.col("start_dist") / METERS_PER_MILE).alias("c_start"), (F.col("end_dist") / METERS_PER_MILE).alias("c_end"), "dir", "radius_m", "length_m", "delta", "transition", F.col("min_radius_m"))
        m = C.compound_groups(rows, p.merge_gap_ft, "path")
        c = m.select("path", (F.col("c_start") * METERS_PER_MILE).alias("start_dist"), (F.col("c_end") * METERS_PER_MILE).alias("end_dist"), ((F.col("c_end") - F.col("c_start")) * METERS_PER_MILE).alias("length_m"), "radius_m", "min_radius_m", "delta", "dir", "transition", "banking", "bin", "merge_status")
    step = vertices.groupBy("path").agg(F.first("spacing").alias("_step"))
    c = c.join(step, "path").withColumns({"_from": F.floor(F.col("start_dist") / F.col("_step") + 1e-6), "_to": F.floor(F.col("end_dist") / F.col("_step") + 1e-6)})
    line = C.sliced(c, vertices.select("path", "idx", F.col("lon").alias("x"), F.col("lat").alias("y")), "path", "_from", "_to", "idx")
    return calibrated(line.drop("_from", "_to", "_step"), paths)


def vertical(vertices: DataFrame, paths: DataFrame, p: Params) -> DataFrame:
    """Crests and sags of all chains, with their class and whether a known structure lies in a sag."""
    names = ["path", "start_dist", "end_dist", "length_m", "length_ft", "grade_in", "grade_out", "alg_diff", "k_value", "kind", "offset_ft"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, v = gathered(frames, {"dist_m": float, "z": float})
        d, z = v["dist_m"], v["z"]
        grade = profile.slope(z, d)
        grade *= 100
        if rows := profile.vertical_curves(d, z, grade, p):
            yield pd.DataFrame([{"path": first["path"], **r} for r in rows], columns=names)

    kinds = ", ".join(f"{c} {'string' if c in ('path', 'kind') else 'double'}" for c in names)
    c = spread(vertices.select("path", "idx", "dist_m", "z"), "path").groupBy("path").applyInPandas(run, kinds)
    c = calibrated(c, paths).withColumn("bin", grade_bin(F.col("alg_diff")))
    known = vertices.where("tier in (1, 2)").select("path", "Milepost")
    sags = c.where("kind = 'SAG'").select("path", "start_mp", "end_mp").distinct()
    hit = intervals.holding(sags, known, "path", "start_mp", "end_mp", "Milepost").withColumn("false_valley", F.lit(True))
    return c.join(hit, ["path", "start_mp", "end_mp"], "left").withColumn("false_valley", F.coalesce("false_valley", F.lit(False)))


def tagged(vertices: DataFrame, sections: DataFrame, h: DataFrame, v: DataFrame) -> DataFrame:
    """Vertices with what holds at them: kind and class of the horizontal and vertical curve of their chain, and the roughness reported for their section.

    The last of several counts. Curves are held against distances along the chain, sections against mileposts. Curves are
    'Tangent' of class A where there is none; `curve` has the horizontal one's direction, 'Compound' before it for a merged
    one. A section without a reported value takes the value away; without a column of that name there is none.
    """
    paths = vertices.groupBy("path").agg(F.first("RouteId").alias("RouteId"), F.min("Milepost").alias("_low"), F.max("Milepost").alias("_high"))
    turn = F.concat(F.when(F.col("merge_status") == "Compound", "Compound ").otherwise(""), F.col("dir"))
    along = lambda df, name, value: df.select(*interval(name, "dist_m", "start_dist", "end_dist", ["start_dist", "end_dist"], value))
    every = along(h, "curve", turn).unionByName(along(h, "H_Curve_Type", "dir")).unionByName(along(h, "H_Curve_Bin", "bin")).unionByName(along(v, "V_Curve_Type", "kind")).unionByName(along(v, "V_Grade_Bin", "bin"))
    names = ["curve", "H_Curve_Type", "H_Curve_Bin", "V_Curve_Type", "V_Grade_Bin", "IRI_Reported"]
    iri = next((c for c in sections.columns if c.upper() == "IRI"), None)
    if iri:
        own = sections.select("RouteId", "Start_MP", "End_MP", F.col(iri).try_cast("double").alias("_iri")).join(paths, "RouteId").where("Start_MP <= _high and End_MP >= _low")
        every = every.unionByName(own.select(*interval("IRI_Reported", "Milepost", "Start_MP", "End_MP", ["Start_MP", "End_MP"], "_iri")))
    got = attributes(vertices, every, "path", "idx", ["dist_m", "Milepost"], names)
    out = vertices.join(got, ["path", "idx"], "left")
    tangent = {c: F.coalesce(c, F.lit("Tangent" if c.endswith("Type") else "A")) for c in names[1:5]}
    return out.withColumns({**tangent, "IRI_Reported": F.col("IRI_Reported").cast("double")})


def scored(sections: DataFrame, h: DataFrame, v: DataFrame) -> DataFrame:
    """Sections with the worst class of the horizontal and of the vertical curves that they overlap, A without any; repeated sections keep a row each.

    Both kinds of curves meet the sections in one join, and each class is a partial maximum.
    """
    own = sections.select(F.col("RouteId").alias("route_id"), "FSystem", F.least("Start_MP", "End_MP").alias("start_mp"), F.greatest("Start_MP", "End_MP").alias("end_mp"))
    own = own.groupBy("route_id", "FSystem", "start_mp", "end_mp").agg(F.count("*").alias("_copies"))
    one = lambda c, a, b: c.select(F.col("RouteId").alias("route_id"), F.col("start_mp").alias("c_start"), F.col("end_mp").alias("c_end"), a.alias("_h"), b.alias("_v"))
    none = F.lit(None).cast("string")
    curves = one(h, F.col("bin"), none).unionByName(one(v, none, F.col("bin")))
    s = intervals.worst_bins(own, curves, ["FSystem", "_copies"], {"_h": "h_bin", "_v": "v_bin"})
    return s.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).drop("_copy", "_copies").withColumnRenamed("route_id", "RouteId")


def intersections(vertices: DataFrame, radius: float = TOPOLOGY_RADIUS_DEG) -> DataFrame:
    """Where two routes cross, one row a pair of routes: kind, both mileposts and elevations (feet), and the place on the first.

    Pairs are vertices of different routes within radius (degrees) whose elevations are within AT_GRADE_FT of each other or
    over GRADE_SEPARATED_FT apart; of a pair of routes the first vertices count, by chain and index of the lesser route,
    then of the other.
    """
    n = vertices.select(F.struct("low", "path", "idx").alias("node_id"), F.col("RouteId").alias("route_id"), "lon", "lat", F.col("Elev_Ft").alias("elev"), F.col("Milepost").alias("mp"))
    best = spatial.first_pairs(n, radius, True).withColumn("kind", topology(F.col("dz")))
    names = {"kind": "Topology_Node", "lon": "Lon", "lat": "Lat", "mp": "MP_A", "elev": "Elev_A_Ft", "o_mp": "MP_B", "o_elev": "Elev_B_Ft", "dz": "Elev_Diff_Ft"}
    return best.select(F.col("route_id").alias("Route_A"), F.col("o_route_id").alias("Route_B"), *[F.col(c).alias(a) for c, a in names.items()])


def health(vertices: DataFrame) -> DataFrame:
    """RMSE, in feet, up and sideways between read and smoothed vertices of every chain: (path, RouteId, FSystem, RMSE_V_ft, RMSE_H_ft)."""
    up = F.pow((F.col("z_raw") - F.col("z")) * FEET_PER_METER, 2)
    side = F.pow((F.col("lat_raw") - F.col("lat")) * DEGREE_FT, 2) + F.pow((F.col("lon_raw") - F.col("lon")) * DEGREE_FT * F.cos(F.radians("lat")), 2)
    return vertices.groupBy("path", "RouteId", "FSystem").agg(F.sqrt(F.avg(up)).alias("RMSE_V_ft"), F.sqrt(F.avg(side)).alias("RMSE_H_ft"))


def tiers(vertices: DataFrame, horizontal: DataFrame) -> DataFrame:
    """Of every route its vertices, those of each structure tier, the share of known structures (tiers 1 and 2), and its curves with spirals."""
    of = lambda k: F.count_if(F.col("Structure_Tier") == TIERS[k])
    counts = vertices.groupBy("RouteId").agg(F.count("*").alias("vertices"), *[of(k).alias(f"tier_{k}") for k in (1, 2, 3)])
    spirals = horizontal.where("transition = 'Spiral'").groupBy("RouteId").agg(F.count("*").alias("spirals"))
    return counts.withColumn("known_share", (F.col("tier_1") + F.col("tier_2")) / F.col("vertices")).join(spirals, "RouteId", "left").withColumn("spirals", F.coalesce("spirals", F.lit(0)))


def vertex_table(vertices: DataFrame, state: str) -> DataFrame:
    """Vertices under the names and with the digits of the published table, with what holds at them; Dist_Mi goes on along the chains of a route, by their low mileposts, from where the route begins."""
    ends = vertices.groupBy("RouteId", "path").agg(F.min("low").alias("low"), F.max("dist_m").alias("_long"))
    w = Window.partitionBy("RouteId").orderBy("low", "path")
    before = F.coalesce(F.sum("_long").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.min("low").over(Window.partitionBy("RouteId")) * METERS_PER_MILE
    v = vertices.join(ends.withColumn("_before", before).select("path", "_before"), "path")
    digits = {"Milepost": ("Milepost", 4), "Dist_Mi": ((F.col("_before") + F.col("dist_m")) / METERS_PER_MILE, 4), "Elev_Ft": (F.col("z") * FEET_PER_METER, 3), "Elev_Raw_Ft": (F.col("z_raw") * FEET_PER_METER, 3), "Grade_Pct": ("grade", 3), "Heading_Deg_Unwrapped": ("heading", 5), "Micro_Jitter_Inches": ("roughness", 4), "Available_Sight_Dist_Ft": ("asd_ft", 1)}
    made = {name: F.round(c, n).alias(name) for name, (c, n) in digits.items()}
    own = {"State_ID": F.lit(state).alias("State_ID"), "Lon": F.col("lon").alias("Lon"), "Lat": F.col("lat").alias("Lat"), "Raw_Lon": F.col("lon_raw").alias("Raw_Lon"), "Raw_Lat": F.col("lat_raw").alias("Raw_Lat"), "Part": F.col("low").alias("Part")}
    order = ("State_ID", "RouteId", "FSystem", "Milepost", "Dist_Mi", "Lon", "Lat", "Elev_Ft", "Raw_Lon", "Raw_Lat", "Elev_Raw_Ft", "Grade_Pct", "Heading_Deg_Unwrapped", "Structure_Tier", "Micro_Jitter_Inches", "Available_Sight_Dist_Ft", "Part", "H_Curve_Type", "V_Curve_Type", "H_Curve_Bin", "V_Grade_Bin", "IRI_Reported")
    return v.select(*[made.get(c, own.get(c, F.col(c))) for c in order])


def aligned(sections: DataFrame, structures: DataFrame, raster: DataFrame, p: Params) -> Alignment:
    """The flow over sections (RouteId, FSystem, Start_MP, End_MP, Structure_Type, WKT in degrees, perhaps IRI), an inventory of structures (structure_id, lon, lat, vertical_clearance) and a raster of elevations (tile, row, col, z).

    A chain that fails is a row of errors and stops no other. Plan and vertices are written to the shared folder at once, curves when they are asked for,
    so all that follows reads them, and none depends on an executor.
    """
    folder = new_folder(sections.sparkSession, "alignment")
    plan = written(planned(projected(stitch(pieces(sections), p)), p), f"{folder}/plan")
    sound = plan.where("error is null")
    at = spatial.sampled(sound, raster, "lon_raw", "lat_raw", "z_read")
    up = profiled(masked(at, sections, structures), p)
    # Rows of failed profiles have no vertex to join; they are told apart by the error.
    both = up.join(sound.drop("error"), ["path", "idx"], "left")
    return Alignment(sections, plan, written(both, f"{folder}/vertices"), p, folder)


@dataclass(frozen=True)
class Sheet:
    """Plan and profile of one route: its alignment, its vertices turned by pages, and the share of blind samples outside sags."""

    alignment: Alignment
    pages: DataFrame
    blind: DataFrame


def plan_profile(sections: DataFrame, structures: DataFrame, raster: DataFrame, p: Params, route: str, start: float | None = None, end: float | None = None, page_ft: float = 1500.0) -> Sheet:
    """The flow for the sections of one route that touch [start, end], under the route's most frequent functional system, and its sheets.

    A page holds page_ft of a chain, turned level and scaled to mileposts; a route without sections is an error.
    """
    own = route_clip(sections.withColumnsRenamed({"RouteId": "route_id", "Start_MP": "start_mp", "End_MP": "end_mp"}), route, start, end)
    own = own.withColumnsRenamed({"route_id": "RouteId", "start_mp": "Start_MP", "end_mp": "End_MP"})
    system = own.agg(F.mode("FSystem", True)).first()[0]
    if system is None:
        raise ValueError(f"no sections of route {route}")
    a = aligned(own.withColumn("FSystem", F.lit(system).cast("int")), structures, raster, p)
    feet = a.vertices.select("path", F.floor(F.col("dist_m") * FEET_PER_METER / page_ft).alias("page"), "idx", (F.col("x") * FEET_PER_METER).alias("x"), (F.col("y") * FEET_PER_METER).alias("y"), F.col("Milepost").alias("mp"))
    sags = a.vertical.where("kind = 'SAG'").select(F.col("path").alias("route_id"), "start_dist", "end_dist", "kind")
    at = intervals.point_in_interval(a.vertices.select(F.col("path").alias("route_id"), "idx", "dist_m", "asd_ft"), sags, "dist_m", "start_dist", "end_dist", "start_dist", "kind", ["idx", "asd_ft"])
    short = F.col("asd_ft") < BLIND_FT
    blind = at.groupBy(F.col("route_id").alias("path")).agg(F.avg(short.cast("double")).alias("blind"), F.avg((short & F.col("kind").isNull()).cast("double")).alias("blind_not_sag"))
    return Sheet(a, spatial.pages(feet, ["path", "page"], "idx"), blind)
