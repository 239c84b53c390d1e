"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embdup, langid, licenses, media, mixing, neardup, phrases, pii, quality, resampling, tokenfile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.stored_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op7_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.similar_vectors(_table(spark, sf_dir, "embeddings"), least=0.93)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"), mixing.PRODUCTION)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(_table(spark, sf_dir, "conversations"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality": op2_quality,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_token_files": op4_token_files,
    "op5_licenses": op5_licenses,
    "op6_media": op6_media,
    "op7_embedding_duplicates": op7_embedding_duplicates,
    "op8_mixing": op8_mixing,
    "op9_personal_data": op9_personal_data,
    "op10_language_id": op10_language_id,
    "op11_target_resampling": op11_target_resampling,
    "op12_chat_format": op12_chat_format,
    "op13_phrases": op13_phrases,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op5_licenses": licenses.oracle_sql(),
    "op8_mixing": mixing.oracle_sql(mixing.PRODUCTION),
    "op11_target_resampling": resampling.oracle_sql(),
    "op12_chat_format": chat.oracle_sql(),
    "op13_phrases": phrases.oracle_sql(),
}
