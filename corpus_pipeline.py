"""Corpus preparation: each stage works on the written result of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skillweft.llm.stages import STAGES
from skillweft.session import fresh_folder

#: No SQL counterpart: a learned score, tokens and a forest are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
