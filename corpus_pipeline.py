"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next stage's docs.
All stages but the last return the columns of the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm.mixing import mixed
from touchline.llm.near_text import one_near_text
from touchline.llm.packing import pack
from touchline.llm.pii import pseudonymise_column
from touchline.llm.quality import quality_filter
from touchline.llm.store import fresh_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash and min-hash candidates with 5-word similarities of 0.8: the one with the smallest doc_id."""
    return one_near_text(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by format-preserving pseudonyms; n_chars follows the text."""
    return pseudonymise_column(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the sources interleaved by the Pfair schedule."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of ids, numbered in the order of the schedule.

    A table's files are read in any order, so documents are dealt by ranges of slots once more: each
    partition packs one range, and its number leads the numbers of its windows.
    """
    return pack(mixed(docs), keep=False)  # the same workers run the other stages


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("pii_pseudonyms", pii),
    ("pfair_mixing", mix_sources),
    ("packing", packing),
]

#: Fingerprints, pseudonyms, schedules and tokenizers are beyond SQL: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
