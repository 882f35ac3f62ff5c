"""What the operators of this subpackage share: the shared folder, materialising, and Arrow batch sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch on its way to Python: long documents must not add up to gigabytes.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Keys that are told to every task of a join, at most: those with over 1 / HOT of the rows.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader (the folder may be in a store that only Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir.

    Only where that is unset and Spark runs in this one process, as in tests, a temporary folder of this machine is set
    instead; a cluster without a shared folder is an error, as other machines couldn't read what is written there.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='roadgeo-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(conf)
    return conf.rstrip("/")


def own_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def met(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, apart: list[str], how: str = "inner") -> DataFrame:
    """rows joined with keys, which has one row of each value of `on`; a key of over 1 / HOT of all weight may be in a third of the rows. With how 'left' rows without a key stay, with nulls.

    Such keys are HOT at most, so they are broadcast, and their rows are dealt by the columns `apart` in the join that finds the others.
    """
    total = keys.agg(F.sum(weight)).first()[0] or 0
    more = [c for c in keys.columns if c not in on]
    hot = keys.where(F.col(weight) > total / HOT).select(*on, F.struct(*more).alias("_hot"))
    told = rows.join(F.broadcast(hot), on, "left").withColumn("_deal", F.when(F.col("_hot").isNull(), 0).otherwise(F.xxhash64(*apart)))
    others = keys.select(*on, F.lit(0).cast("long").alias("_deal"), F.struct(*more).alias("_found"))
    joined = told.join(others, [*on, "_deal"], "left").withColumn("_found", F.coalesce("_hot", "_found"))
    joined = joined.where("_found is not null") if how == "inner" else joined
    return joined.select(*rows.columns, "_found.*")


def limit_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, as texts may be very long; bounds of the session that are tighter stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def fresh(df: DataFrame, n: int) -> list[str]:
    """n column names that the table, whatever its columns, doesn't have."""
    taken, names, k = {c.lower() for c in df.columns}, [], 0
    while len(names) < n:
        if f"own_{k}" not in taken:
            names.append(f"own_{k}")
        k += 1
    return names


def as_long(df: DataFrame, name: str):
    """The column as a long, or null where the table has none of that name."""
    return F.col(name).cast("long") if name in df.columns else F.lit(None).cast("long")


def as_text(df: DataFrame, name: str = "text"):
    """The column as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column without decoding; null is empty."""
    return [b or b"" for b in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of the given columns in the schema's types."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by keys into tables of whole groups with `least` rows or more (the last may have fewer)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held)
        last = [whole.column(k)[-1].as_py() for k in keys]
        cut = whole.num_rows
        tail = whole.select(keys)
        lo, hi = 0, cut - 1  # the first row of the last group, by bisection
        while lo < hi:
            mid = (lo + hi) // 2
            if [tail.column(k)[mid].as_py() for k in keys] == last:
                hi = mid
            else:
                lo = mid + 1
        if lo:
            yield whole.slice(0, lo)
        held, rows = whole.slice(lo).combine_chunks().to_batches(), whole.num_rows - lo
    if held:
        yield pa.Table.from_batches(held)
