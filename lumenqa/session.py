"""Session defaults and shared-folder helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, app: str = "lumenqa", memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    n = cpus or os.cpu_count() or 8
    builder = SparkSession.builder.master(f"local[{n}]").appName(app).config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(n)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
