"""Training-corpus pipeline: language ID, near duplicates, decontamination, PII, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes and reads
again; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nazar.llm import decontam, langid, mix, neardup, pii, tables


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without a letter) go."""
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays, the one with the smallest id."""
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontam.decontaminated(docs, tables.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; every document stays."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's manifest: documents it takes, with their copies and words."""
    return mix.mix(docs).where("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
]

#: Components, trained models and dependent rounding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = tables.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = tables.save(stage(spark, docs, sf_dir))
    return docs
