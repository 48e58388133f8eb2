"""Joins of many rows with one row a key, where a key may fill much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_reduced(rows: DataFrame, reduced: DataFrame, column: str, how: str = "inner", spread: Column | None = None) -> DataFrame:
    """Join ``rows`` with an aggregate by ``column``; rows without a key are dealt out by ``spread``.

    The aggregate is already dealt by its key, so a plain join reuses that, and adaptive execution
    cannot split a hot key, which takes an exchange on both sides. A derived key deals both anew.
    Null keys of an outer join would meet in one task; they get keys of their own, which match nothing.
    """
    key = F.concat(F.lit("="), F.col(column).cast("string"))
    own = key if spread is None else F.coalesce(key, F.concat(F.lit("~"), spread.cast("string")))
    right = reduced.withColumn("__key", key).drop(column)
    return rows.withColumn("__key", own).join(right, "__key", how).drop("__key")
