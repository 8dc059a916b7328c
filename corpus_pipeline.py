"""A training corpus in stages: each stage works on all documents that the one before kept.

``run`` applies the stages to the table of documents. Every stage's result is written as
Parquet to the shared folder and read again, so a lost executor never costs a finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.common import stored, table
from meterline.llm.jaccard import keep_one
from meterline.llm.mixing import Mix
from meterline.llm.pieces import encode
from meterline.llm.quality import keep_good
from meterline.llm.secrets import redact

#: SQL can express neither the password scoring nor the encoding; tests use brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its runs of five words."""
    return keep_one(docs, n=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return docs.withColumn("text", redact(F.col("text")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, which may be never or twice."""
    return Mix(docs).documents()


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document of the mix."""
    ids = docs.select("doc_id", "source", encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", secret_scans),
    ("mixing", mixing),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
