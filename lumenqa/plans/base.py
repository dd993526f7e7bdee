"""How a query is registered: its function, and its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name, with the DuckDB SQL for the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query in SQL that Spark plans; ``{table}`` stands for a table. DuckDB runs the same text unless it has its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\{{{t}\}}", text)}
        return spark.sql(text, **used)

    QUERIES[name] = run
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", oracle or text)
