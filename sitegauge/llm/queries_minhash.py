"""Registered query of near-duplicate classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegauge.llm.common import table
from sitegauge.llm.minhash import near_duplicates


def op3_probminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
