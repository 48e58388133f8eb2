"""Local sessions for tests and the benchmark; on a cluster the submitter configures Spark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str, cpus: str = "8", **config: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "sitegauge.inputPartitions": cpus if cpus.isdigit() else "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Python call sites of column expressions are only needed for debugging plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **config,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
