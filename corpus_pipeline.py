"""The corpus pipeline: stages that clean and encode the documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from usagelens.llm.stages import decontaminate, encode, near_duplicates, quality, repeated_passages
from usagelens.llm.store import written

STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("encode", encode),
]
#: A trained score and segmentation by search are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
