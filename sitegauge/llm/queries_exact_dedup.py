"""Registered query of exact deduplication and its comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegauge.llm.common import table
from sitegauge.llm.exact_dedup import deduplicate


def op9_salted_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the group of texts equal to its own."""
    return deduplicate(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g
    AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
