"""Classes of curves, grades, banking and crossings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AT_GRADE_FT, DEGREE_BINS, DEGREE_OF_CURVE, FEET_PER_METER, GRADE_BINS, GRADE_SEPARATED_FT, SUPERELEVATION_FT


def _letters(x: Column, limits: tuple[float, ...]) -> Column:
    out = F.when(x < limits[0], "A")
    for limit, letter in zip(limits[1:], "BCDE", strict=True):
        out = out.when(x < limit, letter)
    return out.otherwise("F")


def degree_of_curve(radius_m: Column) -> Column:
    return F.when(radius_m > 0, F.lit(DEGREE_OF_CURVE) / radius_m)


def degree_bin(degree: Column) -> Column:
    """A to F by degree of curve; null for null."""
    return F.when(degree.isNotNull(), _letters(degree, DEGREE_BINS))


def grade_bin(grade_pct: Column) -> Column:
    """A to F by the grade's size; null for null."""
    return F.when(grade_pct.isNotNull(), _letters(F.abs(grade_pct), GRADE_BINS))


def superelevation(radius_m: Column) -> Column:
    """Banking in per cent by radius; 0 from the last step on."""
    feet, out = radius_m * FEET_PER_METER, None
    for limit, pct in SUPERELEVATION_FT:
        out = F.when(feet < limit, pct) if out is None else out.when(feet < limit, pct)
    return F.when(radius_m.isNotNull(), out.otherwise(0.0))


def topology(dz_ft: Column) -> Column:
    """Kind of a crossing by the difference of elevations; null between the two."""
    return F.when(F.abs(dz_ft) > GRADE_SEPARATED_FT, "Grade-Separated").when(F.abs(dz_ft) <= AT_GRADE_FT, "At-Grade")


def clearance_m(text: Column) -> Column:
    """A clearance code: four digits are hundredths of a metre, anything else a number of feet; only positive ones count."""
    clean = F.trim(text)
    metres = F.when(clean.rlike(r"^\d{4}$"), clean.try_cast("double") / 100).otherwise(clean.try_cast("double") / FEET_PER_METER)
    return F.when(metres > 0, metres)
