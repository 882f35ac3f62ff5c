"""The queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, codes, license, media, mixing, phrases, quality, simhash, suffix, tokens, toxicity, warc
from .common import table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings, by inner product, of every twentieth."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.with_hex(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload, stored as an image in archives and read back."""
    return media.columns(table(spark, sf_dir, "documents"))


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return license.scan(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, beside its source's target."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a net trained on labelled rows outside the held-out fold. An empty or null text has the score of no words; repeated rows have one each."""
    docs = table(spark, sf_dir, "documents")
    return quality.digest(toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), 0.5)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, encoded and decoded."""
    return bpe.encoded(table(spark, sf_dir, "documents"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that strings of 200 bytes found elsewhere too cover."""
    return suffix.removed(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by trees fitted on labelled rows outside the held-out fold. An empty or null text has the score of its statistics, which are 0; repeated rows have one each."""
    docs = table(spark, sf_dir, "documents")
    return quality.digest(quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels"))), quality.CUT)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's WARC record, written to seekable bundles and read back."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document; empty and null texts have none."""
    return tokens.counted(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two to four words of every language; empty and null texts have no words, a null language is `und`."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every embedding without null or non-finite components, and the digest of the codebooks."""
    return codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_simhash": op2_simhash,
    "op3_media": op3_media,
    "op4_license": op4_license,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_suffix": op8_suffix,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_tokens": op11_tokens,
    "op12_phrases": op12_phrases,
    "op13_codes": op13_codes,
}

ORACLES: dict[str, str] = {
    "op4_license": license.oracle_sql(),
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
                     CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to FROM d""",
    "op12_phrases": phrases.oracle_sql(),
    "op13_codes": codes.oracle_sql(),
}
