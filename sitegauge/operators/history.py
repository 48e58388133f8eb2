"""Audit history per account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.constants import HISTORY_ROWS


def history_rows(scored: DataFrame, additive: Column) -> DataFrame:
    """Rows to append; ``scored`` holds ``email``, ``created_at`` and the ``audit`` struct, ``additive`` is the additive score."""
    return scored.select(
        "email", F.coalesce(F.nullif("url", F.lit("")), F.lit("unknown")).alias("url"), F.col("audit.score").alias("score"),
        compact_json(additive).alias("analysis"), "created_at",
    )


def compact_json(score: Column) -> Column:
    """The stored short form of an audit as whole JSON: the additive score, and score, grade, counts and summary of the audit."""
    audit = F.struct(*[F.col(f"audit.{k}").alias(k) for k in ("score", "grade", "counts", "summary")])
    return F.to_json(F.struct(F.col("url").alias("url"), score.alias("score"), audit.alias("audit")), {"ignoreNullFields": "false"})


def history_compact(scored: DataFrame, additive: Column) -> DataFrame:
    return scored.select("email", "url", compact_json(additive).alias("analysis"))


def history_latest(history: DataFrame, limit: int = HISTORY_ROWS) -> DataFrame:
    """Newest entries of every account."""
    order = Window.partitionBy("email").orderBy(F.desc("created_at"), F.desc("url"))
    ranked = history.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("email", "rank", "url", "score", "created_at")
