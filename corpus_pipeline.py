"""A training corpus from ``documents``: five stages, each calling one operator of pixelmill.llm.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``. Nulls, empty and very long texts, ties,
repeated rows and clashing columns are handled as the operators' docstrings say; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pixelmill.llm import decontaminate, mixing, packing, quality, simhash
from pixelmill.llm._util import shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those that SimHash or a similarity of 0.8 over five-word shingles links."""
    return simhash.one_of_each(docs, 0.8)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to tempered shares of source, language and form (see mixing.topic_of)."""
    return mixing.sampled(docs)


def pack_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become rows of packed token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("mixture", sample_mixture),
    ("packing", pack_ids),
]

#: The stages learn, hash and align; SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, writing each result to the folder that executors share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
