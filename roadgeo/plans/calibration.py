"""Calibration of smoothing factors from sections to audit rows: chunks of a mile, a sample, the sweep, gates, choice.

The sweep runs one kernel over each sampled chunk, all factors at once; gates, early exit and choice are windows and
aggregates over its rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import AUDIT_COLUMNS, DEGREE_FT, FEET_PER_METER, METERS_PER_MILE_CHUNK, SWEEP_FACTORS, VOID_M, Params, smoothing_factor
from ..functions.geo import tile_corner, utm_inverse
from ..kernels import profile, projection, smooth
from ..operators import statistics as S
from ..storage import new_folder, written
from .alignment import pieces, spread, stitch
from .flow import projected

CHUNK = "chunk string, FSystem int, epsg int, xs array<double>, ys array<double>"
POINT = "chunk string, FSystem int, epsg int, idx int, dist_m double, spacing double, x double, y double"
SWEEP = "chunk string, FSystem int, factor int, v_rmse double, h_rmse double, max_v_dev double, max_h_dev double, curve_var double"
#: Raster cells of a block's side, elevations that a chunk of mode H must have.
BLOCK, LEAST_KNOWN = 64, 10


def mile_chunks(chains: DataFrame) -> DataFrame:
    """Chains of metres cut into miles; a rest of half a mile or so (800 m) is a chunk too, a shorter one and a chain below 1600 m are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            x, y = np.asarray(r.xs, float), np.asarray(r.ys, float)
            at = np.concatenate(([0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))))
            if not at[-1] >= 1600:
                continue
            full = int(at[-1] / METERS_PER_MILE_CHUNK)
            for i in range(full + (at[-1] - full * METERS_PER_MILE_CHUNK >= 800)):
                a, b = i * METERS_PER_MILE_CHUNK, min((i + 1) * METERS_PER_MILE_CHUNK, at[-1])
                d = np.concatenate(([a], at[np.searchsorted(at, a, "right") : np.searchsorted(at, b, "left")], [b]))
                out.append((f"{r.path}/{i}", r.FSystem, r.epsg, np.interp(d, at, x), np.interp(d, at, y)))
        return pd.DataFrame(out, columns=["chunk", "FSystem", "epsg", "xs", "ys"])

    return spread(chains, "path").groupBy("path").applyInPandas(run, CHUNK)


def sample(chunks: DataFrame, seed: int = 3) -> DataFrame:
    """Of each functional system as many chunks, drawn by hash, as Cochran's formula asks for, with total and sampled numbers."""
    total = chunks.groupBy("FSystem").agg(F.count("*").alias("total_chunks")).withColumn("sample_chunks", S.sample_size(F.col("total_chunks")))
    place = F.row_number().over(Window.partitionBy("FSystem").orderBy(F.xxhash64("chunk", F.lit(seed)), "chunk"))
    return chunks.withColumn("_k", place).join(F.broadcast(total), "FSystem").where("_k <= sample_chunks").drop("_k")  # a row for each system


def densified(chunks: DataFrame, spacing_m: float) -> DataFrame:
    """Points of every chunk at equal spacing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r in pdf.itertuples(index=False):
            x, y = np.asarray(r.xs, float), np.asarray(r.ys, float)
            at = np.concatenate(([0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))))
            n = max(2, int(np.ceil(at[-1] / spacing_m)) + 1)
            d = np.linspace(0, at[-1], n)
            parts.append(pd.DataFrame({"chunk": r.chunk, "FSystem": r.FSystem, "epsg": r.epsg, "idx": np.arange(n, dtype=np.int32), "dist_m": d, "spacing": at[-1] / (n - 1), "x": np.interp(d, at, x), "y": np.interp(d, at, y)}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=[c.split()[0] for c in POINT.split(", ")])

    return spread(chunks, "chunk").groupBy("chunk").applyInPandas(run, POINT)


def windows(points: DataFrame, raster: DataFrame, reach_m: float, per_degree: int) -> DataFrame:
    """Raster cells (row, col, z) of each chunk (`of`), counted from the pole and from 180 degrees west, that lie about a chunk's points as far as reach_m in either direction; voids are left out.

    Chunks and cells meet in blocks of BLOCK x BLOCK cells, so a cell goes only to the chunks near it.
    """
    far = F.lit(reach_m / 111_000.0)
    box = points.groupBy("chunk").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.max(F.abs("lat")).alias("_lat"))
    wide = far / F.cos(F.radians(F.least("_lat", F.lit(89.0))))
    row, col = lambda lat: F.floor((90 - lat) * per_degree), lambda lon: F.floor((lon + 180) * per_degree)
    box = box.select("chunk", (row(F.col("y1") + far) - 1).alias("r0"), (row(F.col("y0") - far) + 1).alias("r1"), (col(F.col("x0") - wide) - 1).alias("c0"), (col(F.col("x1") + wide) + 1).alias("c1"))
    block = lambda c: F.floor(F.col(c) / BLOCK)
    box = box.withColumn("_br", F.explode(F.sequence(block("r0"), block("r1")))).withColumn("_bc", F.explode(F.sequence(block("c0"), block("c1"))))
    north, west = tile_corner(F.col("tile"))
    cell = raster.where(F.col("z") >= VOID_M).select(((90 - north) * per_degree + F.col("row")).cast("long").alias("row"), ((west + 180) * per_degree + F.col("col")).cast("long").alias("col"), "z")
    cell = cell.withColumns({"_br": block("row"), "_bc": block("col")})
    return cell.join(box, ["_br", "_bc"]).where("row between r0 and r1 and col between c0 and c1").select(F.col("chunk").alias("of"), "row", "col", F.col("z").cast("double").alias("z"))


def turning(lon: np.ndarray, lat: np.ndarray) -> float:
    """Mean turn of heading between edges, in degrees."""
    head = np.unwrap(np.arctan2(np.diff(lat), np.diff(lon)))
    return float(np.degrees(np.abs(np.diff(head))).mean()) if len(head) > 1 else 0.0


def sideways(lon_raw: np.ndarray, lat_raw: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Feet between points as read and as smoothed, a degree of latitude being DEGREE_FT."""
    return np.hypot((lat_raw - lat) * DEGREE_FT, (lon_raw - lon) * DEGREE_FT * np.cos(np.radians(lat)))


def swept(points: DataFrame, raster: DataFrame, p: Params, mode: str, factors: tuple[int, ...] = SWEEP_FACTORS, per_degree: int = 2400) -> DataFrame:
    """v_rmse, h_rmse, max_v_dev, max_h_dev (feet) and curve_var (degrees) of every chunk under every factor.

    A chunk meets the raster cells about it in one group, where it is sampled as often as its positions move. Mode H
    smooths the path by each factor and reads the ground under both paths; a chunk with fewer than LEAST_KNOWN elevations
    under either has no row for that factor. Mode V keeps the path of the other mode's factor and smooths the repaired
    ground by each; a chunk without any elevation has no row.
    """
    names = [c.split()[0] for c in SWEEP.split(", ")]
    lon, lat = utm_inverse(F.col("x"), F.col("y"), F.col("epsg"))
    at = points.withColumns({"lon": lon, "lat": lat})
    other = max(max(factors), *(smoothing_factor(p, "H", k) for k in range(1, 8)))
    near = windows(at, raster, float(np.sqrt(other)) + 1.0, per_degree)  # no point is moved farther, as squares of all moves add up to the factor

    def run(v: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame(columns=names)
        v = v.sort_values("idx")
        epsg, fs, step = int(v.epsg.iloc[0]), int(v.FSystem.iloc[0]), float(v.spacing.iloc[0])
        ground = projection.Window(held.row.to_numpy(), held.col.to_numpy(), held.z.to_numpy(float), per_degree)
        d, x, y, lon_raw, lat_raw = (v[c].to_numpy(float) for c in ("dist_m", "x", "y", "lon", "lat"))
        read = ground.at(lon_raw, lat_raw)
        out = []

        def path(factor: int):
            lon, lat = projection.utm_inverse(smooth.smoothing_spline(d, x, factor), smooth.smoothing_spline(d, y, factor), epsg)
            h = sideways(lon_raw, lat_raw, lon, lat)
            return lon, lat, float(np.sqrt((h**2).mean())), float(h.max()), turning(lon, lat)

        if mode == "V":
            if not np.isfinite(read).any():
                return pd.DataFrame(columns=names)
            none = np.zeros(len(v), int)
            raw = smooth.filled(read)
            fixed, _ = profile.repair_dips(raw, profile.trend_of(raw, none, step, p), none, step, p)
            _, _, h_rmse, h_max, turn = path(smoothing_factor(p, "H", fs))
        for f in factors:
            if mode == "V":
                up = np.abs(smooth.smoothing_spline(d, fixed, f) - raw) * FEET_PER_METER
            else:
                lon, lat, h_rmse, h_max, turn = path(f)
                under = ground.at(lon, lat)
                if min(np.isfinite(under).sum(), np.isfinite(read).sum()) < LEAST_KNOWN:
                    continue
                up = np.abs(read - under)[np.isfinite(read) & np.isfinite(under)] * FEET_PER_METER
            out.append((v.chunk.iloc[0], fs, f, float(np.sqrt((up**2).mean())) if len(up) else 0.0, h_rmse, float(up.max()) if len(up) else 0.0, h_max, turn))
        return pd.DataFrame(out, columns=names)

    own = spread(at.select("chunk", "FSystem", "epsg", "idx", "dist_m", "spacing", "x", "y", "lon", "lat"), "chunk")
    return own.groupBy("chunk").cogroup(near.groupBy("of")).applyInPandas(run, SWEEP)


def drawn_points(sections: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Sampled chunks of a state's sections, written to the shared folder, and their points calibrate_ft apart."""
    drawn = written(sample(mile_chunks(projected(stitch(pieces(sections), p)))), new_folder(sections.sparkSession, "chunks"))
    return drawn, densified(drawn.select("chunk", "FSystem", "epsg", "xs", "ys"), p.metres("calibrate_ft"))


def audited(sections: DataFrame, raster: DataFrame, p: Params, mode: str, mountain: bool = False) -> DataFrame:
    """A row of AUDIT_COLUMNS for each functional system of a state's sections: the factor chosen for its paths (mode H) or profiles (mode V), and why.

    Fewer than three chunks of a system give no row. Sampled chunks and their sweep, bounded by the sample, are written to the
    shared folder, as the table reads either several times.
    """
    drawn, at = drawn_points(sections, p)
    done = written(swept(at, raster, p, mode), new_folder(sections.sparkSession, "sweep"))
    joint = S.collated_joint(done, ["FSystem", "factor"])
    rows = S.audit_table(joint, "FSystem", mode, F.col("FSystem"), F.lit(mountain))
    sizes = drawn.groupBy("FSystem").agg(F.first("total_chunks").alias("total_chunks"), F.first("sample_chunks").alias("sample_chunks"))
    given = {"timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), "state_fips": F.lit(p.state)}
    return rows.join(F.broadcast(sizes), "FSystem").withColumns(given).select(*AUDIT_COLUMNS)  # a row for each system
