"""Kernels as table functions for SQL: of a table of samples, partitioned by path and in the order of idx."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from ..config import Params
from ..kernels import profile, smooth


def _samples(table: AnalyzeArgument, needed: tuple[str, ...]) -> None:
    if not table.isTable:
        raise ValueError("a TABLE argument is needed")
    gone = [c for c in ("path", "idx", *needed) if c not in table.dataType.fieldNames()]
    if gone:
        raise ValueError(f"the table has no column {', '.join(gone)}")


def _result(names: list[tuple[str, type]], **own) -> AnalyzeResult:
    schema = StructType()
    for name, kind in names:
        schema = schema.add(name, kind())
    return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("path")], orderBy=[OrderingColumn("idx")], **own)


class VerticalCurves:
    """Crests and sags of each path of TABLE(path, idx, dist_m, z)."""

    NUMBERS = ("start_dist", "end_dist", "length_m", "length_ft", "grade_in", "grade_out", "alg_diff", "k_value", "offset_ft")

    def __init__(self):
        self.path, self.d, self.z = None, [], []

    @staticmethod
    def analyze(samples: AnalyzeArgument) -> AnalyzeResult:
        _samples(samples, ("dist_m", "z"))
        return _result([("path", StringType), ("kind", StringType), *((c, DoubleType) for c in VerticalCurves.NUMBERS)])

    def eval(self, row: Row):
        self.path = row["path"]
        self.d.append(row["dist_m"])
        self.z.append(row["z"])

    def terminate(self):
        if len(self.d) > 1:
            d, z = np.array(self.d, float), np.array(self.z, float)
            for c in profile.vertical_curves(d, z, np.gradient(z, d) * 100, Params()):
                yield (self.path, c["kind"], *(float(c[n]) for n in self.NUMBERS))


class RepairedProfile:
    """Ground of each path of TABLE(path, idx, z), spacing_m apart, with dips below its trend bridged: path, idx, z, tier (3 where bridged)."""

    def __init__(self):
        self.path, self.idx, self.z, self.spacing = None, [], [], 1.0

    @staticmethod
    def analyze(samples: AnalyzeArgument, spacing_m: AnalyzeArgument) -> AnalyzeResult:
        _samples(samples, ("z",))
        if spacing_m.value is None or float(spacing_m.value) <= 0:
            raise ValueError("spacing_m is a constant above 0")
        return _result([("path", StringType), ("idx", IntegerType), ("z", DoubleType), ("tier", IntegerType)])

    def eval(self, row: Row, spacing_m: float):
        self.path, self.spacing = row["path"], float(spacing_m)
        self.idx.append(row["idx"])
        self.z.append(np.nan if row["z"] is None else row["z"])

    def terminate(self):
        if self.idx:
            p, known = Params(), np.zeros(len(self.idx), int)
            ground = smooth.filled(np.array(self.z, float))
            z, tier = profile.repair_dips(ground, profile.trend_of(ground, known, self.spacing, p), known, self.spacing, p)
            yield from ((self.path, int(i), float(a), int(t)) for i, a, t in zip(self.idx, z, tier, strict=True))


def register(spark: SparkSession) -> None:
    """`vertical_curves` and `repaired_profile` for the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("vertical_curves", udtf(VerticalCurves))
    spark.udtf.register("repaired_profile", udtf(RepairedProfile))
