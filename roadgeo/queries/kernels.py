"""Numeric kernels over groups of samples; most have no SQL twin, the tests hold them against numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import views as V
from ..config import Params
from ..kernels import profile, smooth
from ..operators.nearest import nearest_of_all
from ..plans import alignment as A
from ..registry import query


def _per_route(p: DataFrame, f) -> DataFrame:
    """A kernel over each route's samples in order; Arrow, as frames of pandas cost more than the kernels where routes are many and short."""

    def run(t: pa.Table) -> pa.Table:
        idx = t["idx"].to_numpy()
        order = np.argsort(idx, kind="stable")
        z = t["z"].to_numpy()[order].astype(float)
        return pa.table({"route_id": t["route_id"], "idx": idx[order], "value": np.round(f(z), 6)})

    return A.spread(p.select("route_id", "idx", "z"), "route_id").groupBy("route_id").applyInArrow(run, "route_id long, idx long, value double")


@query()
def spline_smooth(spark, d):
    return _per_route(V.profile(spark, d), lambda z: smooth.smoothing_spline(np.arange(len(z)) * 5.0, z, 100.0 * len(z)))


@query()
def savgol(spark, d):
    return _per_route(V.profile(spark, d), smooth.savgol)


@query()
def roughness_proxy(spark, d):
    return _per_route(V.profile(spark, d), lambda z: smooth.roughness(z - z.mean(), 5.0))


@query()
def dip_repair(spark, d):
    p = Params(dip_ft=50.0)

    def fix(z: np.ndarray) -> np.ndarray:
        trend = pd.Series(z).rolling(21, center=True, min_periods=1).median().to_numpy()
        return profile.repair_dips(z, trend, np.zeros(len(z), int), 5.0, p)[0]

    return _per_route(V.profile(spark, d), fix)


@query()
def vertical_curves(spark, d):
    p = Params(v_min_length_ft=50.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, z = pdf.idx.to_numpy(float) * 5, smooth.savgol(pdf.z.to_numpy(float), 15)
        rows = [{"route_id": pdf.route_id.iloc[0], **r} for r in profile.vertical_curves(x, z, np.gradient(z, x) * 100 if len(x) > 1 else z * 0, p)]
        return pd.DataFrame(rows, columns=["route_id", "start_dist", "end_dist", "alg_diff", "k_value", "kind"]).round(6)

    return A.spread(V.profile(spark, d).select("route_id", "idx", "z"), "route_id").groupBy("route_id").applyInPandas(run, "route_id long, start_dist double, end_dist double, alg_diff double, k_value double, kind string")


def _sections(spark, d) -> DataFrame:
    """Customers as short sections of 25 routes, end to end in the order of their ids."""
    k = F.col("c_custkey")
    i = F.floor(k / 25)
    at = lambda j: F.concat_ws(" ", (i * 40.0 + j).cast("string"), (F.sin((i * 40.0 + j) / 200) * 50 + F.col("c_nationkey") % 1).cast("string"))
    line = F.concat(F.lit("LINESTRING ("), F.array_join(F.array(*[at(j) for j in (0.0, 10.0, 20.0, 30.0, 40.0)]), ", "), F.lit(")"))
    return V.table(spark, d, "customer").select((k % 25).cast("string").alias("RouteId"), (k % 7 + 1).cast("int").alias("FSystem"), (i * 0.025).alias("Start_MP"), ((i + 1) * 0.025).alias("End_MP"), line.alias("WKT"))


@query()
def stitch_greedy(spark, d):
    s = A.stitch(A.pieces(_sections(spark, d)), Params())
    return s.select("RouteId", "FSystem", "part_no", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.size("xs").alias("n"))


@query(V.sql("""+s AS (SELECT node_id AS smooth_id, lon + 0.00001::DOUBLE AS lon, lat FROM nodes), p AS (SELECT node_id, smooth_id, sqrt(pow(n.lon - s.lon, 2) + pow(n.lat - s.lat, 2)) AS d FROM nodes n CROSS JOIN s)
    SELECT node_id, smooth_id, round(round(d, 9), 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY round(d, 9), smooth_id) AS k FROM p) WHERE k = 1""", "nodes"))  # fmt: skip
def raw_to_smooth_nearest(spark, d):
    n = V.nodes(spark, d)
    s = n.select(F.col("node_id").alias("smooth_id"), (F.col("lon") + 0.00001).alias("s_lon"), F.col("lat").alias("s_lat"))
    return nearest_of_all(n, s, "node_id", "smooth_id", "lon", "lat", "s_lon", "s_lat")


