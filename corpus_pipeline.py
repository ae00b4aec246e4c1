"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes all that the one before kept; toxic documents, copies and near
copies go, repeated passages are cut out of the texts, and the rest is packed.

All stages but the last return the columns of their documents, whatever these
are named. Null texts count as empty: they are judged as such, are copies of each
other, and empty documents take a place of one token when packed. Null ids come
last where one of several documents is kept. Tables without rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulario.llm import exact_dedup, ngram_join, packing, substring, toxicity
from tabulario.llm.queries import BYTE_BPE, labels
from tabulario.llm.ship import send_package
from tabulario.llm.workspace import Workspace


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones, does not reject."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat even that, one."""
    send_package(spark)
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle similarity connects, words in fives, 0.8 or more: the one with the smallest doc_id."""
    send_package(spark)
    return ngram_join.one_of_each(docs, width=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words or more that occur more than once; a text may become empty."""
    send_package(spark)
    return substring.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences: at least one for each row."""
    send_package(spark)
    return packing.pack(docs, *BYTE_BPE)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("substring dedup", without_repeats),
    ("best-fit packing", packed),
]
# A fitted model and a tokenizer are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the table `documents`, each over the written result of the one before."""
    send_package(spark)
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            work.drop(f"stage{k - 1}")
    return docs
