"""Geodesy and geometry as Column expressions: distance, UTM, tiles, cells, WKT."""

from __future__ import annotations

from math import radians, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_MILES

# WGS 84 and the UTM scale.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_E = 2 * sqrt(_N) / (1 + _N)


def haversine_ft(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in feet."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_MILES * 5280) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the point's UTM zone, without the exceptions of the far north."""
    zone = F.floor((lon + 180) / 6) + 1
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing in metres by Krueger's series to the third order."""
    centre = (epsg % 100) * 6 - 183
    phi, lam = F.radians(lat), F.radians(lon - centre)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(_E) * F.atanh(F.lit(_E) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500000.0) + F.lit(_K0 * _RADIUS) * x, F.when(epsg >= 32700, 10000000.0).otherwise(0.0) + F.lit(_K0 * _RADIUS) * y


def utm_inverse(easting: Column, northing: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a point of a UTM zone, by the inverse series."""
    x = (easting - 500000.0) / (_K0 * _RADIUS)
    y = (northing - F.when(epsg >= 32700, 10000000.0).otherwise(0.0)) / (_K0 * _RADIUS)
    xi, eta = y, x
    for j, b in enumerate(_BETA, 1):
        xi = xi - F.lit(b) * F.sin(2 * j * y) * F.cosh(2 * j * x)
        eta = eta - F.lit(b) * F.cos(2 * j * y) * F.sinh(2 * j * x)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + ((epsg % 100) * 6 - 183), F.degrees(phi)


def utm_inverse_sql(easting: str, northing: str, epsg: str) -> tuple[str, str]:
    """The inverse series as DuckDB text."""
    k = f"{_K0 * _RADIUS!r}::DOUBLE"
    x, y = f"(({easting} - 500000.0::DOUBLE) / {k})", f"(({northing} - CASE WHEN {epsg} >= 32700 THEN 10000000.0::DOUBLE ELSE 0.0::DOUBLE END) / {k})"
    xi = " - ".join([y] + [f"{b!r}::DOUBLE * sin({2 * j} * {y}) * cosh({2 * j} * {x})" for j, b in enumerate(_BETA, 1)])
    eta = " - ".join([x] + [f"{b!r}::DOUBLE * cos({2 * j} * {y}) * sinh({2 * j} * {x})" for j, b in enumerate(_BETA, 1)])
    chi = f"asin(sin({xi}) / cosh({eta}))"
    phi = " + ".join([chi] + [f"{d!r}::DOUBLE * sin({2 * j} * {chi})" for j, d in enumerate(_DELTA, 1)])
    return f"degrees(atan2(sinh({eta}), cos({xi}))) + (({epsg} % 100) * 6 - 183)", f"degrees({phi})"


def utm_sql(lon: str, lat: str, epsg: str) -> tuple[str, str]:
    """The same series as DuckDB text."""
    phi, lam = f"radians({lat})", f"radians({lon} - (({epsg} % 100) * 6 - 183))"
    t = f"sinh(atanh(sin({phi})) - {_E!r}::DOUBLE * atanh({_E!r}::DOUBLE * sin({phi})))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    x = " + ".join([eta] + [f"{a!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1)])
    y = " + ".join([xi] + [f"{a!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1)])
    k = f"{_K0 * _RADIUS!r}::DOUBLE"
    return f"500000.0::DOUBLE + {k} * ({x})", f"CASE WHEN {epsg} >= 32700 THEN 10000000.0::DOUBLE ELSE 0.0::DOUBLE END + {k} * ({y})"


def tile_name(lon: Column, lat: Column) -> Column:
    """Name of the one-degree elevation tile: hemisphere letters with two and three digits."""
    return F.format_string("%s%02d%s%03d", F.when(lat >= 0, "n").otherwise("s"), F.ceil(F.abs(lat)).cast("int"), F.when(lon < 0, "w").otherwise("e"), F.ceil(F.abs(lon)).cast("int"))


def tile_corner(tile: Column) -> tuple[Column, Column]:
    """Northern edge and western edge, in whole degrees, of the tile of a name."""
    lat, lon = F.substring(tile, 2, 2).cast("int"), F.substring(tile, 5, 3).cast("int")
    return F.when(F.substring(tile, 1, 1) == "n", lat).otherwise(1 - lat), F.when(F.substring(tile, 4, 1) == "w", -lon).otherwise(lon - 1)


def cell(x: Column, origin: Column, size: float) -> Column:
    return F.floor((x - origin) / size).cast("int")


def rotate(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    """The point turned about the origin."""
    a = radians(degrees)
    return x * F.cos(F.lit(a)) - y * F.sin(F.lit(a)), x * F.sin(F.lit(a)) + y * F.cos(F.lit(a))


def wkt_points(wkt: Column) -> Column:
    """Parts of a LINESTRING or MULTILINESTRING (Z and M allowed) as arrays of struct<x, y>, null where a coordinate is no number; null for any other text."""
    parts = F.transform(F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1), lambda p: F.transform(F.split(p, ","), lambda xy: _point(F.split(F.trim(xy), r"\s+"))))
    return F.when(F.upper(F.trim(wkt)).rlike(r"^(MULTI)?LINESTRING"), parts)


def _point(c: Column) -> Column:
    return F.struct(F.get(c, F.lit(0)).try_cast("double").alias("x"), F.get(c, F.lit(1)).try_cast("double").alias("y"))


def path_length(points: Column) -> Column:
    """Planar length of an array of struct<x, y>."""
    steps = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)))
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v))


def wkt_line(points: Column) -> Column:
    """LINESTRING text of an array of struct<x, y>, seven decimals."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.format_string("%.7f %.7f", p["x"], p["y"])), ", "), F.lit(")"))


def wkt_zm(points: Column) -> Column:
    """LINESTRING ZM text of an array of struct<x, y, z, m>: seven, seven, two and four decimals."""
    return F.concat(F.lit("LINESTRING ZM ("), F.array_join(F.transform(points, lambda p: F.format_string("%.7f %.7f %.2f %.4f", p["x"], p["y"], p["z"], p["m"])), ", "), F.lit(")"))
