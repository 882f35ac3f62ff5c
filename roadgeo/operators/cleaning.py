"""Normalising sections, decoding codes, filters, deduplication, validators, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALIASES, GEOMETRY_NAMES, NO_STATE, STATE_NAMES
from .order import running_total

_DEFAULTS = {"Start_MP": 0.0, "End_MP": 0.0, "FSystem": 1, "Facility_Type": 2, "Structure_Type": 0}


def normalized(df: DataFrame) -> DataFrame:
    """Sections under canonical names and types.

    The geometry is the first of GEOMETRY_NAMES, in that order, that the table has. Numbers that can't be read take the
    defaults; RouteId is trimmed and upper-cased text; rows without geometry go. A source that lacks RouteId or any
    geometry is an error. All other columns pass; of two columns for one name the first in the table wins.
    """
    lower = {c.lower(): c for c in reversed(df.columns)}
    shape = next((lower[g] for g in GEOMETRY_NAMES if g in lower), None)
    if shape is None:
        raise ValueError("no geometry column")
    found = {}
    for name, aliases in ALIASES.items():
        own = [c for c in df.columns if c.lower() in aliases or c == name]
        if own:
            found[name] = own[0]
    if "RouteId" not in found:
        raise ValueError("no route column")
    used = {shape, *found.values()}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used and c not in (*ALIASES, "WKT")]
    number = {n: F.coalesce(F.col(f"`{found[n]}`").cast("string").try_cast("double"), F.lit(float(d))) if n in found else F.lit(float(d)) for n, d in _DEFAULTS.items()}
    out = df.select(
        F.upper(F.trim(F.col(f"`{found['RouteId']}`").cast("string"))).alias("RouteId"), number["Start_MP"].alias("Start_MP"), number["End_MP"].alias("End_MP"), *[number[n].cast("int").alias(n) for n in ("FSystem", "Facility_Type", "Structure_Type")],
        F.col(f"`{shape}`").cast("string").alias("WKT"), *rest,
    )
    return out.where("trim(WKT) <> ''")


def for_state(df: DataFrame, state: str) -> DataFrame:
    """Rows of a state by two-digit code; no filter for a sentinel or where no state column is."""
    column = next((c for c in STATE_NAMES if c in df.columns), None)
    if state.upper() in NO_STATE or column is None:
        return df
    text = F.trim(F.col(column).cast("string"))
    return df.where(F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text) == state.zfill(2))


def among(df: DataFrame, **lists) -> DataFrame:
    """Rows whose columns are in the lists; an empty list or None restricts nothing."""
    for column, values in lists.items():
        if values:
            df = df.where(F.col(column).isin(list(values)))
    return df


def route_clip(df: DataFrame, route: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Sections of a route that touch [start, end]."""
    if start is not None and end is not None and end < start:
        raise ValueError("the clip ends before it starts")
    out = df.where(F.upper(F.trim("route_id")) == route.strip().upper())
    out = out if end is None else out.where(F.col("start_mp") <= end)
    return out if start is None else out.where(F.col("end_mp") >= start)


def decimal_degrees(text: Column, longitude: bool) -> Column:
    """A coordinate as decimal degrees: values beyond the range are degrees, minutes and hundredths of seconds in digits, longitudes west."""
    value, width, limit = text.try_cast("double"), 9 if longitude else 8, 180 if longitude else 90
    digits = F.replace(text, F.lit("."), F.lit(""))
    digits = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    n = width - 6
    part = lambda a, k: F.substring(digits, a, k).try_cast("double")
    packed = part(1, n) + part(n + 1, 2) / 60 + part(n + 3, 4) / 100 / 3600
    beyond = value > limit if longitude else F.abs(value) > limit
    return F.when((value.isNull()) | (value == 0), None).when(beyond, -packed if longitude else packed).otherwise(value)


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the named columns that isn't null; a null literal if the table has none of them."""
    own = [F.col(c) for c in names if c in df.columns]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def bare_ampersands(text: Column) -> Column:
    return F.regexp_replace(text, r"&(?![A-Za-z0-9#]+;)", "&amp;")


def safe_route_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r'[<>:"/\\|?*]+', "-"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an order that must be total."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def latest(df: DataFrame, key: str, stamp: str, columns: list[str]) -> DataFrame:
    """The newest row of each key as a partial maximum, without a sort."""
    return df.groupBy(key).agg(F.max(F.struct(stamp, *columns)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in (stamp, *columns)])


def evicted(files: DataFrame, key: str, size: str, age: str, limit: float) -> DataFrame:
    """Files, oldest first, that must go until what stays is within 90 % of the limit; none while all are within it."""
    f = running_total(files, [age, key], size, "_before", inclusive=False)
    total = files.agg(F.sum(size).alias("_all"))
    return f.crossJoin(F.broadcast(total)).where((F.col("_all") > limit) & (F.col("_all") - F.col("_before") > 0.9 * limit)).drop("_all", "_before")  # one row


def violations(df: DataFrame, name: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rows against each rule (rule, severity, SQL condition of a violation), counted in one pass; null isn't a violation unless the condition says so."""
    counts = df.agg(*[F.count_if(F.coalesce(F.expr(c), F.lit(False))).alias(r) for r, _, c in rules])
    cells = ", ".join(f"'{r}', '{s}', `{r}`" for r, s, _ in rules)
    return counts.selectExpr(f"stack({len(rules)}, {cells}) as (rule, severity, n)").select(F.lit(name).alias("table_name"), "rule", "severity", "n")


def report(tables: dict[str, tuple[DataFrame, list[tuple[str, str, str]], list[str], list[str]]]) -> DataFrame:
    """What a check of tables found: (table_name, check, severity, n, value, passed), one row a table's size, rule, missing column and summary of a number.

    Each table comes with its rules, the columns that it must have, and the columns to sum up. A table without a required
    column fails without further rules. An issue that counts any row fails its table; warnings never do. The last row of
    all, 'result', says whether every table passed. One pass over each table.
    """
    out = None
    for name, (df, rules, needed, numbers) in tables.items():
        gone = [c for c in needed if c not in df.columns]
        size = df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("check"), F.lit("info").alias("severity"), "n", F.lit(None).cast("double").alias("value"))
        if gone:
            cells = ", ".join(f"('missing {c}', 'issue', 1L, cast(null as double))" for c in gone)
            found = df.sparkSession.sql(f"SELECT * FROM VALUES {cells} AS t(check, severity, n, value)")
        else:
            found = violations(df, name, rules).select(F.col("rule").alias("check"), "severity", F.col("n").cast("long").alias("n"), F.lit(None).cast("double").alias("value"))
            have = [c for c in numbers if c in df.columns]
            if have:
                ends = df.agg(*[f(F.col(c).try_cast("double")).alias(f"{k}_{c}") for c in have for k, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])
                cells = ", ".join(f"'{k} of {c}', `{k}_{c}`" for c in have for k in ("min", "mean", "max"))
                found = found.unionByName(ends.selectExpr(f"stack({3 * len(have)}, {cells}) as (check, value)").select("check", F.lit("info").alias("severity"), F.lit(None).cast("long").alias("n"), "value"))
        own = size.unionByName(found).select(F.lit(name).alias("table_name"), "check", "severity", "n", F.round("value", 4).alias("value"))
        out = own if out is None else out.unionByName(own)
    out = out.withColumn("passed", (F.col("severity") != "issue") | (F.col("n") == 0))
    result = out.agg(F.bool_and("passed").alias("passed")).select(F.lit("").alias("table_name"), F.lit("result").alias("check"), F.lit("info").alias("severity"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("value"), "passed")
    return out.unionByName(result)


HORIZONTAL_RULES = [("length", "issue", "length_m <= 0"), ("order", "issue", "c_end <= c_start"), ("radius", "warning", "radius_m <= 0"), ("dir", "warning", "dir is null or dir not in ('Left', 'Right')"), ("bin", "warning", "bin is null or bin not in ('A', 'B', 'C', 'D', 'E', 'F')"), ("nulls", "warning", "radius_m is null or length_m is null")]
VERTICAL_RULES = [("length", "issue", "length_m <= 0"), ("order", "issue", "c_end <= c_start"), ("k_value", "warning", "k_value <= 0"), ("kind", "warning", "kind is null or kind not in ('CREST', 'SAG')"), ("bin", "warning", "grade_bin is null or grade_bin not in ('A', 'B', 'C', 'D', 'E', 'F')")]
VERTEX_RULES = [("elevation", "warning", "z is null"), ("grade", "warning", "abs(grade) > 30"), ("backward", "issue", "step < 0"), ("tier", "warning", "tier is null or tier not in ('None', '1_HPMS', '2_NBI', '3_DIP')")]
SCORE_RULES = [("order", "issue", "end_mp < start_mp"), ("h_bin", "warning", "h_bin is null or h_bin not in ('A', 'B', 'C', 'D', 'E', 'F')"), ("route", "issue", "trim(route_id) = ''")]


def incomplete_zm(df: DataFrame, text: str = "wkt_zm") -> DataFrame:
    """Rows with whether all z or all m of a LINESTRING ZM are 0; null text has neither."""
    points = F.transform(F.split(F.regexp_extract(text, r"\(([^)]*)\)", 1), ","), lambda p: F.split(F.trim(p), r"\s+"))
    zero = lambda k: F.forall(points, lambda c: F.get(c, F.lit(k)).try_cast("double") == 0)
    return df.withColumn("zero_z", F.coalesce(zero(2), F.lit(False))).withColumn("zero_m", F.coalesce(zero(3), F.lit(False)))
