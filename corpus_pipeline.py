"""Corpus pipeline: documents to shards ready for training.

Each stage is one of the operators of ``querent.llm`` over all that the stage
before it kept; a stage's result is written before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm.common import fresh
from querent.llm.decontaminate import decontaminate
from querent.llm.mixing import resample
from querent.llm.sharding import shard_rows
from querent.llm.simhash import deduplicate
from querent.llm.toxicity import THRESHOLD, scores, train
from querent.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold."""
    judged = fresh(docs, "_judged")
    index = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs, index, judged).where(F.col(judged)["score"] < THRESHOLD).drop(judged)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item."""
    found = fresh(docs, "_found")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, found).where(F.col(found)["n_hit"] == 0).drop(found)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return resample(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents, and their ``shard``."""
    return shard_rows(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: XXH64 and trained scores are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
