"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and Spark runs in this one process, a temporary one of this machine, which is then set."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='roadgeo-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """The name of a fresh folder below the shared one."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The table, written as Parquet and read again: what follows neither computes it anew nor depends on any executor."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, by Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
