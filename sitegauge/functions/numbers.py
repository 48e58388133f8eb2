"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """``value`` scaled by a power of ten, rounded half away from zero and scaled back, as SQL engines on doubles do.

    ``F.round`` with digits rounds the shortest decimal text instead: 111.64999999999999 times 10
    is 1116.5 as a double, so it is 111.7 here and 111.6 there. What is below zero keeps its sign: -0.0.
    """
    scale = F.lit(float(10**digits))
    size = F.round(F.abs(value.cast("double")) * scale, 0) / scale
    return F.when(value < 0, -size).otherwise(size)
