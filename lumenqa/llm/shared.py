"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import shared_folder as checkpoint_root

#: A key with more than this share of the rows is joined by a broadcast; there are at most as many such keys as its inverse.
HOT_SHARE = 1 / 2000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def write_out(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df once as a table in the shared checkpoint folder; returns what is read back, and the table's folder."""
    folder = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a table of write_out that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle and checkpoint files of steps that nothing refers to; it waits for the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_hot(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows left-joined with table(key, size, ...) by a unique key, where size is how many rows have it.

    Keys with over HOT_SHARE of the total are joined by a broadcast of at most 1 / HOT_SHARE rows, the others by a
    shuffle, so that no task gets a hot key's rows.
    """
    hot = F.col("size") > max(1000, total * HOT_SHARE)
    sent = F.broadcast(table.where(hot).drop("size"))
    rest = rows.join(sent.select(key), key, "left_anti").join(table.where(~hot).drop("size"), key, "left")
    return rows.join(sent, key).unionByName(rest)


#: Rows of an Arrow batch at most: texts are long, and a batch is held by the JVM and by the worker at once.
ARROW_ROWS = 1_000


def _prepared(rows: DataFrame, run: Callable) -> Callable:
    """run, whose workers give back what they no longer use; lowers the session's rows per Arrow batch to ARROW_ROWS where it is larger.

    The setting is read when the plan is made, so it stays lowered.
    """
    spark, key = rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory otherwise
                give_back(0)

    return lean


def map_batches(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """rows.mapInArrow(run, schema) with batches of at most ARROW_ROWS rows."""
    return rows.mapInArrow(_prepared(rows, run), schema)


def map_frames(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """rows.mapInPandas(run, schema) with batches of at most ARROW_ROWS rows."""
    return rows.mapInPandas(_prepared(rows, run), schema)
