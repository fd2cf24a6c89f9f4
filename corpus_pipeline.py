"""A corpus pipeline over ``documents``: language, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapstream.llm import language, minhash, mixing, packing, secrets
from lapstream.llm.common import shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those that language ID rejects (null text, no letter) go.

    Null ids and repeated rows are rows like others; with nothing to learn from, all are rejected."""
    return language.identify(docs, keep=True).where(F.col("lang_pred") != language.UNKNOWN).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the smallest doc_id (null last),
    and of rows repeated with one doc_id and text one. Texts without words all stay."""
    return minhash.deduplicated(docs, words=5, percent=80).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew; null texts, empty texts and repeated rows stay."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight; documents come as often as the mix takes them, and n_chars is counted anew.

    Documents without words take no part; a null source is a source; repeated rows are documents of their own."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens; a null text is an empty one; repeated rows are packed each."""
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_sources", mix), ("pack", pack)]
#: Signatures, a random forest and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written as Parquet in the shared folder and read again.

    The last of these tables is what the result reads, so the folder stays until the cluster clears its checkpoints."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
