"""Registered query of nearest neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.ann import search
from sitegauge.llm.common import table

NEAREST, EVERY = 20, 20


def op10_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every twentieth vector among all."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0, NEAREST)
