"""From sections to chains: pieces of lines, stitched and merged route by route."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions.geo import wkt_points
from ..kernels import chains


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many partitions as the session says: kernels cost far more than their rows' bytes, by which adaptive execution would put them into a few tasks. The grouping that follows needs no other exchange."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pieces(sections: DataFrame) -> DataFrame:
    """One row a part of a section's line: RouteId, FSystem, low, high, xs, ys; bad geometry gives none.

    Texts cost far more to read than their bytes tell, so sections are dealt to all tasks first, however few files they come from.
    """
    own = spread(sections.select("RouteId", "FSystem", F.least("Start_MP", "End_MP").alias("low"), F.greatest("Start_MP", "End_MP").alias("high"), "WKT"), "RouteId", "low", "high", "WKT")
    p = own.select("RouteId", "FSystem", "low", "high", F.explode(wkt_points(F.col("WKT"))).alias("pts"))
    return p.select("RouteId", "FSystem", "low", "high", F.transform("pts", lambda q: q["x"]).alias("xs"), F.transform("pts", lambda q: q["y"]).alias("ys")).where("size(xs) >= 2")


def stitch(parts: DataFrame, p: Params) -> DataFrame:
    """Chains of every route, numbered by low milepost: pieces in the order of mileposts, stitched, then merged where ends are near."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["low", "high"], kind="stable")
        got = [{"points": list(zip(r.xs, r.ys, strict=True)), "low": r.low, "high": r.high} for r in pdf.itertuples()]
        made = sorted(chains.merged(chains.stitched(got, p.snap_deg), p.merge_chunks_ft), key=lambda c: (c["low"], c["high"]))
        fs = int(pdf.FSystem.mode().min())
        return pd.DataFrame([{"RouteId": pdf.RouteId.iloc[0], "FSystem": fs, "part_no": k + 1, "low": c["low"], "high": c["high"], "xs": [q[0] for q in c["points"]], "ys": [q[1] for q in c["points"]]} for k, c in enumerate(made)], columns=["RouteId", "FSystem", "part_no", "low", "high", "xs", "ys"])

    return spread(parts, "RouteId").groupBy("RouteId").applyInPandas(run, "RouteId string, FSystem int, part_no int, low double, high double, xs array<double>, ys array<double>")
