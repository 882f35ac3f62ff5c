"""A training corpus from raw documents: toxicity, near-duplicates, repeated passages, source mix, tokens.

Every stage takes an empty table to an empty one, a null text for an empty one, and rows that repeat or lack an id for rows
of their own; columns beyond those it needs pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadgeo.llm import bpe, mixing, simhash, suffix, toxicity
from roadgeo.llm.common import own_dir, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the net, trained on the labelled ones among them, doesn't find toxic; without any labels, all of them. Empty texts stay."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id, one without id only if none has any. Empty texts are one group."""
    return simhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes or more that stand elsewhere too; what is nothing else becomes empty, null texts do too."""
    return suffix.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice. Documents without a source are a source of their own; empty ones go by number."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text of every document taken; empty texts have none."""
    return bpe.encoded(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: No SQL expresses the net, the trees of Hamming distances or the balanced sample; tests hold each stage and run()
#: against plain forms over all rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = own_dir(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
