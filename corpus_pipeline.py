"""From raw documents to a training mix, in five stages.

Each stage takes ``(spark, docs, folder)``, works on all rows that the stage before kept, and returns a
DataFrame that is written as Parquet and read again as the ``docs`` of the next. All but the last return
the columns of the documents; the last returns what the mix takes of each.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressroom.llm.decontaminate import decontaminate
from pressroom.llm.exact import exact_dedup
from pressroom.llm.mixing import mixed_documents
from pressroom.llm.near import near_dedup
from pressroom.llm.quality import quality_filter
from pressroom.plans.scratch import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the labelled ones nearest to them call good."""
    return quality_filter(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """What a mix of the sources by weight takes of each document."""
    return mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact", exact),
    ("near", near),
    ("benchmark", benchmark),
    ("mixing", mixing),
]

# The classifier has no SQL; tests compare the stages after it with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    here = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = f"{here}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
