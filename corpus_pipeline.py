"""From documents to packed training sequences, in four stages.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return
the columns of ``documents``. What a stage returns is written as Parquet and read by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from temblor.llm import lang_id, mixing, near_dups, packing
from temblor.llm.queries import tokenizer_file
from temblor.llm.registry import ship, table
from temblor.session import new_work_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: no letters, or no language with half of them."""
    ship(spark)
    return lang_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: runs of five words, similarity 0.8 or more."""
    ship(spark)
    return near_dups.drop_near_duplicates(docs, words=5, percent=80, chunks=8)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of good, poor and toxic text ask for."""
    return mixing.mix(docs, mixing.domains_of(table(spark, sf_dir, "labels")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in full windows of 512 to 4096 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language ID", identify_language),
    ("near-duplicate removal", drop_copies),
    ("mixing to target weights", mix_domains),
    ("packing", pack_sequences),
]

# Trained classifiers, similarity joins and a tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        folder = new_work_folder(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
