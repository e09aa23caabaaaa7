"""The corpus pipeline: quality rules, near-duplicates, personal data, source mix, tokens.

Every stage takes (spark, docs, sf_dir) with all its predecessor kept and returns a DataFrame, which is written
as Parquet and read again before the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.llm import bpe, mixing, pii, quality, simhash
from corvella.llm.common import materialize, table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the model go.

    A null or empty text fails (too few words). Repeated rows are judged alike, each by its whole text. An empty table stays
    empty; without labels the base rules alone decide. Further columns stay, whatever their names.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) stays.

    It is the one with the smallest doc_id (null last); of rows that share it the smallest hash decides. Null texts count as
    empty, and texts without a word are copies of each other. An empty table stays empty; further columns stay.
    """
    return simhash.keep_one(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private spans become marks.

    A null text stays null, an empty one empty; repeated rows are changed alike. An empty table stays empty; further columns
    stay, n_chars follows the text.
    """
    return _measured(pii.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, as often as it takes it.

    A null source is a source, the last; null texts count no words and are never taken. Repeated rows are documents each. An
    empty table stays empty; further columns stay.
    """
    return _measured(mixing.keep_mixed(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids; lossless says that the ids decode to the text.

    Null and empty texts have no ids; repeated rows are encoded each; an empty table stays empty.
    """
    encoded = bpe.encode_documents(docs, keep=("doc_id", "lang", "source"), decoded=False)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: SQL can't express the model, the fingerprints, the draws or the merges; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
