"""Registered query of language identification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import table
from sitegauge.llm.language_id import Model, fit, identify, sample

FOLDS, HELD_OUT = 4, 2


def held_out() -> Column:
    """Rows that nothing is learned from; a null id is among them."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(True))


def train(docs: DataFrame) -> Model:
    return fit(*sample(docs.where(~held_out()), "doc_id", "text", "lang"))


def op4_subword_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
