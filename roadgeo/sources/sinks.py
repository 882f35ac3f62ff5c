"""Sinks: partitioned tables, GeoJSON rows, per-state replacement, versioned names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: str | None = "state", mode: str = "overwrite") -> None:
    """Write in folders by a column; with mode 'replace' only the folders that df has are replaced."""
    w = df.write.mode("overwrite" if mode == "replace" else mode)
    if mode == "replace":
        w = w.option("partitionOverwriteMode", "dynamic")
    if by and by in df.columns:
        w = w.partitionBy(by)
    (w.option("header", True) if kind == "csv" else w).format(kind).save(path)


def feature(points: Column, properties: list[str]) -> Column:
    """A GeoJSON feature as text, of an array of struct<x, y> and the named columns."""
    coordinates = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))


def write_features(df: DataFrame, points: str, properties: list[str], path: str) -> None:
    """One GeoJSON feature a line, written by every task for itself."""
    df.select(feature(F.col(points), properties).alias("value")).write.mode("overwrite").text(path)


def write_collection(df: DataFrame, points: str, properties: list[str], path: str) -> None:
    """A GeoJSON FeatureCollection in each file: every task writes one, of its own rows."""

    def run(batches):
        import pyarrow as pa

        features = [t for b in batches for t in b.column(0).to_pylist()]
        if features:
            yield pa.RecordBatch.from_pydict({"value": ['{"type":"FeatureCollection","features":[' + ",".join(features) + "]}"]})

    rows = df.select(feature(F.col(points), properties).alias("value"))
    rows.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def enriched_columns(df: DataFrame, fields: list[str] | None) -> DataFrame:
    """All columns (None), the five core ones ([]), or these and the named; class columns of the input in any case are dropped first."""
    core = [c for c in ("RouteId", "FSystem", "Start_MP", "End_MP", "WKT_ZM") if c in df.columns]
    bins = [c for c in df.columns if c.lower() in ("h_curve_bin", "v_grade_bin") and c not in ("H_Curve_Bin", "V_Grade_Bin")]
    df = df.drop(*bins)
    return df if fields is None else df.select(*core, *[f for f in fields if f in df.columns and f not in core])


def next_version(names: list[str], stem: str) -> str:
    """The stem with the version after the highest among names."""
    import re

    found = [int(m[1]) for n in names if (m := re.match(rf"{re.escape(stem)}_v(\d+)\b", n))]
    return f"{stem}_v{max(found, default=0) + 1}"
