"""Intermediate results of the corpus operators, and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.sources.scratch import discard, fresh_dir, shared_dir, written

__all__ = ["discard", "fresh_dir", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
