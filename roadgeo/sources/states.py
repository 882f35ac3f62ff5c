"""A table of states that several writers may change at once: new files first, then a manifest that names what is valid.

A manifest is a file with the next number, which only one writer can create. Who comes second takes the first one's manifest
as the new base and tries the number after it: writers of different states both last, of one state the later does. A writer
that dies before its manifest leaves files that none names, and the table as it was.
"""

from __future__ import annotations

import json
import os
import re
import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MANIFEST = re.compile(r"manifest-(\d{12})\.json$")
#: Attempts of a commit; each that fails has seen another one's succeed.
ATTEMPTS = 100


class Conflict(Exception):
    """A manifest of this number is there already."""


class Folder:
    """A table's folder, by Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self._path("")):
            return []
        return sorted(int(m[1]) for s in self.fs.listStatus(self._path("")) if (m := MANIFEST.search(s.getPath().getName())))

    def manifest(self, number: int) -> dict[str, str]:
        stream = self.fs.open(self._path(f"manifest-{number:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict[str, str]]:
        """Number and content of the newest manifest; 0 and nothing of a new table."""
        numbers = self.numbers()
        return (numbers[-1], self.manifest(numbers[-1])) if numbers else (0, {})

    def commit(self, number: int, content: dict[str, str]) -> None:
        """Create the manifest of a number, whole and at once, or raise Conflict if it is there.

        It is written under a name of its own and then given its number: on a local disk by a link, which can't replace a
        file, elsewhere by a rename, which file systems of clusters refuse if the name is taken.
        """
        own, name = f".{uuid.uuid4().hex}.json", f"manifest-{number:012d}.json"
        stream = self.fs.create(self._path(own), False)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        if self.local:
            base = urllib.parse.urlparse(self.path).path if "://" in self.path or self.path.startswith("file:") else self.path
            try:
                os.link(f"{base}/{own}", f"{base}/{name}")
            except FileExistsError:
                raise Conflict(name) from None
            finally:
                self.fs.delete(self._path(own), False)
        elif self.fs.exists(self._path(name)) or not self.fs.rename(self._path(own), self._path(name)):
            self.fs.delete(self._path(own), False)
            raise Conflict(name)


def upsert(df: DataFrame, path: str, by: str = "state") -> int:
    """Replace the states that df has in the table at path, and leave all others; returns the number of the manifest.

    Rows without a state are a state of their own. Files are written once, whoever else commits in the meantime.
    """
    spark = df.sparkSession
    folder, name = Folder(spark, path), f"data-{uuid.uuid4().hex}"
    key = F.coalesce(F.col(by).cast("string"), F.lit("__none__"))
    rows = df.withColumn("_state", key)
    rows.write.partitionBy("_state").parquet(f"{folder.path}/{name}")
    mine = {r[0]: name for r in spark.read.schema(rows.schema).parquet(f"{folder.path}/{name}").select("_state").distinct().collect()}
    if not mine:
        return folder.latest()[0]  # nothing to replace
    for _ in range(ATTEMPTS):
        number, content = folder.latest()
        try:
            folder.commit(number + 1, content | mine)
            return number + 1
        except Conflict:
            continue
    raise RuntimeError(f"{path}: {ATTEMPTS} other commits came first")


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as the newest manifest, or that of a number, has it."""
    folder = Folder(spark, path)
    content = folder.manifest(number) if number else folder.latest()[1]
    if not content:
        raise FileNotFoundError(f"{path}: no manifest")
    by_data: dict[str, list[str]] = {}
    for state, data in content.items():
        by_data.setdefault(data, []).append(state)
    out = None
    for data, states in sorted(by_data.items()):
        kinds = spark.read.parquet(f"{folder.path}/{data}").schema
        kinds = StructType([StructField("_state", StringType()) if f.name == "_state" else f for f in kinds])  # '01' is no number
        part = spark.read.schema(kinds).parquet(f"{folder.path}/{data}").where(F.col("_state").isin(states)).drop("_state")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def vacuum(spark: SparkSession, path: str, keep: int = 10) -> None:
    """Remove manifests before the newest `keep`, and data that none of these names; not while a writer is at work, whose files none names yet."""
    folder = Folder(spark, path)
    numbers = folder.numbers()
    named = {d for n in numbers[-keep:] for d in folder.manifest(n).values()}
    for n in numbers[:-keep]:
        folder.fs.delete(folder._path(f"manifest-{n:012d}.json"), False)
    for s in folder.fs.listStatus(folder._path("")):
        if s.getPath().getName().startswith("data-") and s.getPath().getName() not in named:
            folder.fs.delete(s.getPath(), True)
