"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Defined cases, of all stages: an empty table gives an empty one; other columns go along to the last stage, whatever their names; rows that are
repeated are rows of one document each; a very long text is one document like others. What becomes of null ids and texts is said
at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fnatlas.llm import decontam, langid, minhash, mixing, token_store
from fnatlas.llm.common import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those whose language can't be told: null texts, texts without letters, and scores close to chance."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; of rows with one id, one. A null id takes no part and stays; a null text is like no other."""
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't make up a twentieth of or more; one without words stays."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so that each source comes near its target; one without words is never taken."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The written tables' documents as they are read back: places, numbers of tokens and checksums; a null text has its end token only."""
    return token_store.token_tables(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: SQL can't train a network, sketch or tokenize; tests compare the stages with plain code instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
