"""Reuse of built column expressions.

A page audit holds some thousand expressions, and each costs the Python driver a few calls into
the JVM. Columns are unresolved until a frame uses them, so one built column serves every frame
of the application.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, SparkSession


def column_cache(build: Callable[..., Column]) -> Callable[..., Column]:
    """Build the column once per Spark application and argument tuple (hashable arguments only)."""
    built: dict[tuple, Column] = {}

    @wraps(build)
    def get(*args) -> Column:
        session = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        key = (session.sparkContext.applicationId, args)
        if key not in built:
            built[key] = build(*args)
        return built[key]

    return get
