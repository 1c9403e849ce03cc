"""The corpus operators as registered queries, with their production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import exactdedup, langid, licenses, media, mixing, neardup, packing, pfp, quality, tokencount

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rest(divisor: int) -> Column:
    """crc32(doc_id as text) mod divisor."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), checksum=True)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), _rest(4) != 2)
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(_rest(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.LIMIT).cast("int").alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.groups(_table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.to_media(_table(spark, sf_dir, "documents")))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.digest(pfp.dedup(_table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weights(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs, _rest(5) != 0))
    return out.select("doc_id", F.coalesce(_rest(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_packing, op2_minhash_near_dedup, op3_quality_classifier, op4_exact_dedup, op5_media_columns, op6_license_scans, op7_suffix_array_dedup, op8_mixing, op9_language_id, op10_token_counts)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op8_mixing": mixing.oracle_sql(),
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_FOLD} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
}
