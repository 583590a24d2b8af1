"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``.  All stages but the last return the columns of ``documents``; the last one returns pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evalforge.llm import mixing, packing, quality, simhash, toxicity
from evalforge.llm._base import release, remove, shared_dir, staged_now, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity segments: documents scored toxic go.  The model is fitted on the labelled of ``docs``."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that both views together reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row for each piece of a sequence."""
    return packing.packed(docs)


STAGES = [("toxicity", toxic), ("quality", good), ("dedup", dedup), ("mixing", mix), ("packing", pack)]
#: The classifiers and the random rounding are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage read and what it staged is deleted once its result is written; the last result stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        mark = staged_now()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, mark)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
