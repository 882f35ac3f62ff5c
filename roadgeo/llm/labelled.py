"""Labelled documents to fit classifiers on: all of them in shards, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_long, as_text, materialize

#: Rows with this remainder of crc32(doc_id as text) by FOLDS are held out from every fit.
FOLDS, HELD_OUT = 5, 0
#: Bits of the table that tells which documents may be labelled: a row for 64 of them, so it is broadcast, whatever the number of labels.
HINT_BITS = 1 << 24


def fold(column):
    """crc32 of the id's decimal text, modulo FOLDS."""
    return F.crc32(column.cast("string").cast("binary")) % FOLDS


def known(labels: DataFrame, label: str) -> DataFrame:
    """id and y of the labelled ids outside the held-out fold; ids that are null, or labelled both ways, are out."""
    y = F.col(label).cast("int")
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), y.alias("y")).where("id is not null and y in (0, 1)").where(fold(F.col("id")) != HELD_OUT)
    return rows.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")


def every(docs: DataFrame, labels: DataFrame, label: str, shard_rows: int) -> DataFrame:
    """id, text, y and rest (one id in five) of all labelled rows outside the held-out fold, written once; a partition is a shard of about shard_rows rows.

    Ids decide the shard and the order in it, so shards are the same in each run and on each cluster. A table of hashed bits
    leaves out most texts without a label before texts are shuffled; the join then is exact. Of repeated ids the least text counts.
    """
    once = known(labels, label)
    shards = max(1, -(-once.count() // shard_rows))
    hint = lambda df: df.withColumn("_bit", F.pmod(F.xxhash64("id"), F.lit(HINT_BITS))).withColumn("_word", F.floor(F.col("_bit") / 64))
    told = hint(once).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, cast(_bit % 64 as int)))").alias("_bits"))
    texts = hint(docs.select(as_long(docs, "doc_id").alias("id"), as_text(docs).alias("text")))
    maybe = texts.join(F.broadcast(told), "_word").where(F.expr("(shiftright(_bits, cast(_bit % 64 as int)) & 1L) = 1L")).select("id", "text")
    found = maybe.repartition(shards, "id").groupBy("id").agg(F.min("text").alias("text")).join(once.repartition(shards, "id"), "id")
    rest = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(5)) == 4
    return materialize(found.select("id", "text", "y", rest.alias("rest")).sortWithinPartitions(F.xxhash64("id", F.lit(11)), "id"))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, by_class: bool) -> DataFrame:
    """text and y of at most `most` labelled rows outside the held-out fold, the same rows in each run.

    The ids are drawn by hash from the labels alone (of each class half as many at most, if by_class), so the join that
    fetches their texts broadcasts a number of ids bounded by `most`. Ids that are null, or labelled both ways, are out.
    """
    once = known(labels, label)
    order = F.xxhash64("id", F.lit(11))
    if by_class:
        ranked = [once.where(F.col("y") == c).orderBy(order, "id").limit(most // 2) for c in (0, 1)]
        drawn = ranked[0].union(ranked[1])
    else:
        drawn = once.orderBy(order, "id").limit(most)
    texts = docs.select(as_long(docs, "doc_id").alias("id"), as_text(docs).alias("text"))
    found = texts.join(F.broadcast(drawn), "id")
    first = F.row_number().over(Window.partitionBy("id").orderBy("text"))
    return found.withColumn("k", first).where("k = 1").select("id", "text", "y")
