"""The corpus pipeline: classify, deduplicate exactly, deduplicate nearly, decontaminate, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents, extra ones included.

Stages drop rows by their doc_id while it names one row each. Where a doc_id repeats or is null, the rows are numbered first, in the order
of doc_id (nulls last) and written once, and a stage decides by the number: rows that share a doc_id but not their text have fates of their own,
of equal rows one stays, and a row without a doc_id is judged like any other. Empty tables give empty tables. Long texts are judged whole. Of
texts that tie, the one with the smallest doc_id stays.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, exact_dedup, ngram_join, packing, quality
from cadenza.llm.shared import discard, materialize, without_ids

#: Near duplicates: words of a shingle, and the similarity as a fraction.
WORDS, NUM, DEN = 5, 80, 100
#: Name of a row's own doc_id while doc_id holds its number.
GIVEN = "_given_doc_id"


def named(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    return docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty()


def by_rows(dropped: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage that keeps all rows of docs but those whose doc_id `dropped` gives; it sees docs with doc_ids that name one row each."""

    @functools.wraps(dropped)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if named(docs):
            return without_ids(docs, dropped(spark, docs, sf_dir))
        own = F.col("doc_id").cast("long")
        ordered = docs.withColumn(GIVEN, F.col("doc_id")).orderBy(own.asc_nulls_last(), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
        numbered = materialize(ordered.withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
        rest = without_ids(numbered, dropped(spark, numbered, sf_dir))
        return rest.withColumn("doc_id", F.col(GIVEN)).select(*docs.columns)

    return stage


@by_rows
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    if GIVEN in docs.columns:
        labels = docs.select("doc_id", F.col(GIVEN).cast("long").alias(GIVEN)).join(labels.withColumnRenamed("doc_id", GIVEN), GIVEN).select("doc_id", "quality")
    judged = quality.classify(docs, labels)
    return materialize(judged.where("not kept").select("doc_id"), "rejected")


@by_rows
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, keep the one with the smallest doc_id."""
    return materialize(exact_dedup.deduplicate(docs).where("not kept").select("doc_id"), "copies")


@by_rows
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, keep the document with the smallest doc_id."""
    judged = ngram_join.near_duplicates(docs, WORDS, NUM, DEN)
    return materialize(judged.where("doc_id <> component_id").select("doc_id"), "near-copies")


@by_rows
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark passage."""
    return decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the remaining documents with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: The classifier and the alignment are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
            if last is not None:
                discard(last)
            last = docs
    return docs
