"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

All stages but the last filter rows and return the columns of documents, extra ones of any name among
them; the last returns each remaining document's token ids in digest. Every stage reads whole texts,
of any length, of all rows that the stage before kept, and an empty table gives an empty one. By stage:

* Toxicity drops what it scores at 0.3 or more, with a model of the labelled rows. A null or empty text
  has the score that the model gives to no n-grams; rows that repeat or tie are scored alike.
* Exact deduplication keeps, of texts that are equal but for the case of A-Z, the row with the largest
  doc_id, a null one last; null and empty texts are equal to each other. Of rows that tie, one stays.
* The n-gram Jaccard join keeps, of each class, the row with the least doc_id, a null one first; texts
  without words are a class each. Of rows that tie, one stays.
* Decontamination drops rows that hold ten consecutive words of a benchmark item, or all words of a
  shorter one; a null or empty text never does, and rows that repeat or tie go together.
* Byte-level BPE gives a row for each row; a null or empty text has no ids.

What a stage writes besides its result is deleted once the result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, contamination, exact_dedup, near_dup, toxicity
from quarry.llm.common import parquet, scope, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, parquet(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.drop_toxic(docs, model, 0.3)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs)


def not_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(docs, parquet(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", not_toxic),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_shingles),
    ("benchmark decontamination", not_benchmark),
    ("byte-level BPE", encoded),
]

#: Neither the classifier nor BPE can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        with scope(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{number}", outer=1)
    return docs
