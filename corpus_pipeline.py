"""A training corpus from raw documents: quality, near-duplicates, personal data, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, mixing, neardup, pii, quality
from graphloom.llm.common import Written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; the others go."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near-duplicates (five-word shingles, 0.8) the one with the smallest doc_id."""
    found = neardup.near_duplicates(docs, k=5, percent=80)
    going = found.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(going, "doc_id", "left_anti").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mixture takes them."""
    return mixing.mixed_documents(docs, mixing.PRODUCTION)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids: each whole text as byte-level BPE ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained models and hash-drawn selections are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages make of ``documents``."""
    out = Written(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, out.table(stage(spark, docs, sf_dir), name)
        out.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
