"""Derivatives, headings, trends and gaps along ordered samples, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def gradient(x: Column, w: WindowSpec, h: float = 1.0) -> Column:
    """Central differences, one-sided at the ends; null for a single sample."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.when(first, (after - x) / h).when(last, (x - before) / h).otherwise((after - before) / (2 * h))


def unwrap_step(d: Column) -> Column:
    """What must be added to a step of degrees so that it lies within half a turn."""
    m = F.pmod(d + 180, F.lit(360.0)) - 180
    fixed = F.when((m == -180) & (d > 0), 180.0).otherwise(m)
    return F.when(F.abs(d) < 180, 0.0).otherwise(fixed - d)


def interpolated(z: Column, idx: Column, partition: list[str], order: str) -> Column:
    """Gaps filled linearly by position, with the nearest value at the ends."""
    back = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*partition).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(z.isNotNull(), idx)
    i0, i1 = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
    z0, z1 = F.last(z, ignorenulls=True).over(back), F.first(z, ignorenulls=True).over(ahead)
    return F.when(z.isNotNull(), z).when(z0.isNull(), z1).when(z1.isNull(), z0).otherwise(z0 + (z1 - z0) * (idx - i0) / (i1 - i0))


def islands(new: Column, w: WindowSpec) -> Column:
    """Number of the run that a row belongs to, from a flag on each run's first row."""
    return F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
