"""Rank correlation of every parameter with a target, without a group of rows in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import truncate_label
from .order import cut, running


def inversions(values: np.ndarray, weights: np.ndarray) -> int:
    """The weight of all pairs that stand in falling order, bit by bit from the highest: equal higher bits, a one before a zero."""
    total = 0
    for bit in range(max(1, int(values.max(initial=0)).bit_length())):
        prefix = values >> (bit + 1)
        order = np.argsort(prefix, kind="stable")
        one, start, w = (values[order] >> bit) & 1, np.searchsorted(prefix[order], prefix[order]), weights[order]
        ones = np.concatenate(([0], np.cumsum(w * one)))
        total += int(((ones[:-1] - ones[start]) * w)[one == 0].sum())
    return total


def _told(rows: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([str(r[1]) for r in rows], pa.string())], ["g", "discordant"])


def _local(rows: DataFrame, block: str, order: list[str], value: str) -> DataFrame:
    """(g, discordant) of each block: the weight of its inversions of ``value`` in the given order; values are made ranks in the block first."""

    def finish(held: list) -> list[tuple[str, int]]:
        table = pa.Table.from_batches(held)
        group = table.column("g").to_pylist()
        out, start = [], 0
        cols = [table.column(c).to_numpy() for c in (*value.split(","), "w")]
        for i in range(1, len(group) + 1):
            if i == len(group) or group[i] != group[start]:
                keys = np.unique(np.stack([c[start:i] for c in cols[:-1]], 1), axis=0, return_inverse=True)[1].ravel()
                out.append((group[start], inversions(keys, cols[-1][start:i])))
                start = i
        return out

    def run(batches):
        held, now = [], None
        for batch in batches:
            at = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
            for a, b in zip(edges, edges[1:]):
                if held and at[a] != now:
                    yield _told(finish(held))
                    held = []
                now = at[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield _told(finish(held))

    columns = [block, "g", "x", "y", "w", "yb"]
    dealt = rows.select(*dict.fromkeys(columns)).repartition(block).sortWithinPartitions(block, "g", *order)
    return dealt.mapInArrow(run, "g string, discordant string").select("g", F.col("discordant").cast("decimal(38,0)").alias("discordant"))


def discordant_pairs(cells: DataFrame) -> DataFrame:
    """(g, discordant) of distinct cells (g string, x double, y double, w long): pairs of rows where x rises and y falls, w rows a cell.

    Cells are cut into ranges in the order of (g, x, y) and in that of (g, y, x). A pair that falls in y is in two y-ranges of one
    x-range, in two of both, or in one y-range: the first are counted by a task an x-range, the last by a task a y-range,
    and those between by the sizes of all pairs of ranges. Equal values are told apart by the other one in rising order, so
    they never count, and a value that all rows share is spread over ranges too.
    """
    by_x = cut(cells.repartitionByRange("g", "x", "y").withColumn("xb", F.spark_partition_id()))
    rows = cut(by_x.repartitionByRange("g", "y", "x").withColumn("yb", F.spark_partition_id()))
    within_x = _local(rows.withColumnRenamed("xb", "block"), "block", ["x", "y"], "yb")
    within_y = _local(rows.withColumn("block", F.col("yb")), "block", ["x", "y"], "y,x")
    sizes = rows.groupBy("g", "xb", "yb").agg(F.sum("w").alias("n"))  # ranges x ranges, whatever the number of rows
    above = sizes.select("g", F.col("xb").alias("xa"), F.col("yb").alias("ya"), F.col("n").alias("na"))
    between = sizes.join(above, "g").where("xa < xb and ya > yb").select("g", (F.col("n").cast("decimal(19,0)") * F.col("na").cast("decimal(19,0)")).cast("decimal(38,0)").alias("discordant"))
    return within_x.union(within_y).union(between).groupBy("g").agg(F.sum("discordant").alias("discordant"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def tau_b(rows: DataFrame) -> DataFrame:
    """(g, tau, n) of rows (g string, x, y numbers): Kendall's tau-b of each group and its number of rows; null where a side is constant.

    Rows with a null x or y are left out; groups of any size are spread over tasks.
    """
    cells = rows.select("g", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    cells = cut(cells.groupBy("g", "x", "y").agg(F.count(F.lit(1)).alias("w")))
    ties = lambda *keys: cells.groupBy("g", *keys).agg(F.sum("w").alias("w")).groupBy("g").agg(F.sum(_pairs(F.col("w").cast("double"))).alias("t" + "".join(keys)), F.sum("w").alias("n" + "".join(keys)))
    counts = ties("x").join(ties("y"), "g").join(ties("x", "y"), "g").join(discordant_pairs(cells), "g", "left")
    all_pairs = _pairs(F.col("nx").cast("double"))
    p, q = all_pairs - F.col("tx"), all_pairs - F.col("ty")
    both = all_pairs - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.coalesce(F.col("discordant").cast("double"), F.lit(0.0))
    return counts.select("g", F.when((p > 0) & (q > 0), both / F.sqrt(p * q)).alias("tau"), F.col("nx").alias("n"))


def what_correlates(rows: DataFrame, params: list[str], target: str, prefix: str = "params_") -> DataFrame:
    """(parameter, value, correlation, count, strength): Kendall's tau-b of every parameter with the target.

    A numeric parameter of over three distinct values (null is one) has one row with value ``*`` and the count of its not
    null rows; a constant one too, without a correlation; any other has a row for each of its values as text ("None" for null), where
    1 for that value and 0 for all others is correlated, and the count is that of the rarer of the two. strength is the mean of a
    parameter's absolute correlations weighted by count, null if one is null. Rows without a target count but aren't correlated.

    A value's correlation follows from the target's ranks: its rows' numbers of smaller less larger targets add up to the
    pairs that agree less those that don't, so values are not multiplied with rows.
    """
    numeric = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)}
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col(c)).alias(f"d_{c}") for c in params], *[F.count(F.col(c)).alias(f"n_{c}") for c in params]).first()
    kinds = {c: stats[f"d_{c}"] + (stats[f"n_{c}"] < stats["n"]) for c in params}
    constant = [c for c in params if kinds[c] <= 1]
    ranked = [c for c in params if kinds[c] > 3 and c in numeric]
    labelled = [c for c in params if c not in constant and c not in ranked]
    spark = rows.sparkSession
    fields = "parameter string, value string, correlation double, count long"
    parts = [spark.createDataFrame([(c, "*", None, stats[f"n_{c}"]) for c in constant], fields)]
    if ranked:
        long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("g"), F.col(c).cast("double").alias("x")) for c in ranked])).alias("p"), F.col(target).cast("double").alias("y")).select("p.g", "p.x", "y")
        told = spark.createDataFrame([(c, stats[f"n_{c}"]) for c in ranked], "g string, count long").join(tau_b(long), "g", "left")
        parts.append(told.select(F.col("g").alias("parameter"), F.lit("*").alias("value"), F.col("tau").alias("correlation"), "count"))
    if labelled:
        parts.append(_labels(rows, labelled, target))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    whole = Window.partitionBy("parameter")  # a row a value
    weighted = F.sum(F.abs("correlation") * F.col("count")).over(whole) / F.sum("count").over(whole)
    complete = F.count("correlation").over(whole) == F.count(F.lit(1)).over(whole)
    return table.withColumn("strength", F.when(complete, weighted)).withColumns({"parameter": F.replace("parameter", F.lit(prefix), F.lit("")), "value": truncate_label(F.col("value"))})


def _labels(rows: DataFrame, labelled: list[str], target: str) -> DataFrame:
    text = lambda c: F.coalesce(F.initcap(F.col(c).cast("string")) if rows.schema[c].dataType == T.BooleanType() else F.col(c).cast("string"), F.lit("None"))
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("parameter"), text(c).alias("value")) for c in labelled])).alias("p"), F.col(target).cast("double").alias("y")).select("p.*", "y")
    cells = cut(long.groupBy("parameter", "value", "y").agg(F.count(F.lit(1)).alias("w")))
    one = cells.where(F.col("parameter") == labelled[0]).where("y is not null").groupBy("y").agg(F.sum("w").alias("w")).withColumn("_all", F.lit(0))
    upto = cut(running(one, "_all", ["y"], {"upto": ("sum", "w")}))
    total = upto.agg(F.sum("w").alias("m"), F.sum(_pairs(F.col("w").cast("double"))).alias("ty")).withColumn("ty", F.coalesce("ty", F.lit(0.0)))
    balance = upto.crossJoin(F.broadcast(total)).select("y", "m", "ty", (2 * F.col("upto") - F.col("w") - F.col("m")).cast("decimal(38,0)").alias("balance"))  # smaller less larger; total is one row
    sizes = cells.groupBy("parameter", "value").agg(F.sum("w").alias("size"))
    met = cells.where("y is not null").join(balance, "y").groupBy("parameter", "value").agg(F.sum(F.col("w") * F.col("balance")).cast("double").alias("s"), F.sum("w").alias("k"), F.first("m").alias("m"), F.first("ty").alias("ty"))
    n = F.sum("size").over(Window.partitionBy("parameter"))
    p, q = F.col("k") * (F.col("m") - F.col("k")), _pairs(F.col("m").cast("double")) - F.col("ty")
    out = sizes.withColumn("n", n).join(met, ["parameter", "value"], "left")
    return out.select("parameter", "value", F.when((p > 0) & (q > 0), F.col("s") / F.sqrt(p * q)).alias("correlation"), F.least("size", F.col("n") - F.col("size")).alias("count"))
