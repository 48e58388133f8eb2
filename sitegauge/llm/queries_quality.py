"""Registered query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import table
from sitegauge.llm.quality import Model, rate, train

FOLDS, HELD_OUT = 3, 1


def held_out() -> Column:
    """Rows that nothing is learned from; a null id is among them."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    return train(docs.where(~held_out()), labels.where(~held_out()))


def op6_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return rate(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
