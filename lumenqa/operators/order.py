"""Places of rows in a whole table, without bringing the table into one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lumenqa-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _with_offsets(rows: DataFrame, name: str) -> DataFrame:
    """rows(_part, _own, ...) with their place: their number in their partition plus the sizes of those before, one row a partition."""
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", before.alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def with_place(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """rows with their place from 0 in the given order, ties in any order; each task sorts one range of it."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return _with_offsets(ranged.withColumn("_own", own.cast("long")), name)


def with_input_place(rows: DataFrame, name: str = "place") -> DataFrame:
    """rows with their place from 0 as they are read: by partition, then within it; a file's rows keep its order as far as Spark deals its splits in order."""
    numbered = cut(rows.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_id")) - 1
    return _with_offsets(numbered.withColumn("_own", own.cast("long")).drop("_id"), name)


def running(rows: DataFrame, group: str, order: list[str], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with running totals of their group in the given order, which must tell its rows apart.

    totals: new column -> (sum, max, min or count, column). Rows are dealt into ranges of (group, order); each range has its
    own totals, to which those of the group's earlier ranges are added, one row a range and group. So a group of any size
    is spread over tasks.
    """
    ranged = cut(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    kinds = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    upto = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({name: kinds[kind](column).over(upto) for name, (kind, column) in totals.items()})
    whole = ranged.groupBy("_part", F.col(group).alias("_group")).agg(*[kinds[kind](column).alias(f"_{name}") for name, (kind, column) in totals.items()])
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    again = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}
    offsets = whole.select("_part", "_group", *[again[kind](f"_{name}").over(before).alias(f"_{name}") for name, (kind, _) in totals.items()])
    joined = own.withColumnRenamed("_part", "_p").join(offsets, (F.col("_p") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    total = lambda name, kind: {
        "max": F.greatest(name, f"_{name}"), "min": F.least(name, f"_{name}"),
    }.get(kind, F.coalesce(F.col(f"_{name}") + F.col(name), F.col(name), F.col(f"_{name}")))
    return joined.select(*rows.columns, *[total(name, kind).alias(name) for name, (kind, _) in totals.items()])


#: Consecutive rows of a group that one task takes in rolling().
SPAN = 100_000


def rolling(rows: DataFrame, group: str, order: list[str], column: str, width: int) -> DataFrame:
    """rows with number (from 0 in their group), mean and n (not null) of the last ``width`` rows, the own one included.

    A group is cut into spans by number; each span also gets the width - 1 rows before it, so no task takes a group.
    """
    numbered = running(rows.withColumn("_one", F.lit(1)), group, order, {"number": ("count", "_one")}).withColumn("number", F.col("number") - 1)
    span = F.floor(F.col("number") / SPAN)
    more = F.when((F.col("number") + width - 1) / SPAN >= span + 1, F.array(span, span + 1)).otherwise(F.array(span))
    spread = numbered.withColumn("_own", span).withColumn("_span", F.explode(more))
    last = Window.partitionBy(group, "_span").orderBy("number").rowsBetween(1 - width, 0)
    out = spread.withColumns({"mean": F.avg(column).over(last), "n": F.count(column).over(last)})
    return out.where("_own = _span").drop("_one", "_own", "_span")


def tiles(rows: DataFrame, group: str, order: list[str], k: int, name: str = "tile") -> DataFrame:
    """rows with the one of k tiles of their group, from 1, that they are in; sizes differ by one at most and the first are the larger ones.

    The order must tell the rows of a group apart; a group of any size is spread over tasks.
    """
    numbered = running(rows.withColumn("_one", F.lit(1)), group, order, {"_number": ("count", "_one")}).drop("_one")
    sizes = rows.groupBy(F.col(group).alias("_key")).agg(F.count(F.lit(1)).alias("_size"))  # a row a group
    small, more = F.floor(F.col("_size") / k), F.col("_size") % k
    at, edge = F.col("_number") - 1, more * (small + 1)
    tile = F.when(at < edge, F.floor(at / (small + 1))).otherwise(more + F.floor((at - edge) / F.greatest(small, F.lit(1)))) + 1
    return numbered.join(sizes, F.col(group).eqNullSafe(F.col("_key"))).withColumn(name, tile.cast("int")).drop("_number", "_size", "_key")
