"""Trial analytics: Pareto fronts, areas, knees, rank correlation, bins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .order import running


#: Parts of a study whose own fronts are found first.
PARTS = 64


def pareto_front(trials: DataFrame, study: str = "study") -> DataFrame:
    """Trials that none of their study dominates (v0 large, v1 small); of equal pairs the smallest number stays, nulls and infinities go.

    One sort instead of a pairwise anti-join: a trial stays if its v0 exceeds all v0 of smaller v1. A study is dealt into PARTS, and
    the front of their fronts is its front, so no task sorts a whole study.
    """
    finite = trials.where("v0 is not null and v1 is not null and abs(v0) < double('infinity') and abs(v1) < double('infinity')")
    dealt = finite.withColumn("_part", F.pmod(F.xxhash64("number"), F.lit(PARTS)))
    return _front(_front(dealt, [study, "_part"]).drop("_part"), [study])


def _front(rows: DataFrame, keys: list[str]) -> DataFrame:
    best = Window.partitionBy(*keys, "v1").orderBy(F.desc("v0"), "number")
    before = Window.partitionBy(*keys).orderBy("v1").rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.withColumn("_place", F.row_number().over(best)).where("_place = 1").withColumn("_before", F.max("v0").over(before))
    return kept.where("_before is null or v0 > _before").drop("_place", "_before")


def pareto_area(trials: DataFrame, study: str = "study") -> DataFrame:
    """(study, area): share of the box (0.1 quantile to largest v0, least to 0.9 quantile of v1) that the front dominates."""
    limits = trials.groupBy(study).agg(F.percentile("v0", 0.1).alias("y0"), F.max("v0").alias("y1"), F.min("v1").alias("x0"), F.percentile("v1", 0.9).alias("x1"))
    clip = lambda c, a, b: F.greatest(F.col(a), F.least(F.col(b), F.col(c)))
    front = pareto_front(trials, study).join(limits, study).withColumns({"x": clip("v1", "x0", "x1"), "y": clip("v0", "y0", "y1")})
    following = F.lead("x").over(Window.partitionBy(study).orderBy("v1"))
    steps = front.withColumn("w", F.coalesce(following, F.col("x1")) - F.col("x"))
    total = (F.first("x1") - F.first("x0")) * (F.first("y1") - F.first("y0"))
    return steps.groupBy(study).agg(F.try_divide(F.sum(F.col("w") * (F.col("y") - F.col("y0"))), total).alias("area"))


def knee(trials: DataFrame, study: str = "study") -> DataFrame:
    """The point of each front that rises most over the line between its ends, both axes on 0..1."""
    whole = Window.partitionBy(study)
    scale = lambda c: F.try_divide(F.col(c) - F.min(c).over(whole), F.max(c).over(whole) - F.min(c).over(whole))
    rows = pareto_front(trials, study).withColumn("rise", F.round(F.coalesce(scale("v0"), F.lit(0.0)) - F.coalesce(scale("v1"), F.lit(0.0)), 9))
    order = Window.partitionBy(study).orderBy(F.desc("rise"), "v1", "number")
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def _inversions(rank: np.ndarray) -> int:
    """Pairs that stand in falling order, bit by bit from the highest: equal higher bits, a one before a zero."""
    total = 0
    for bit in range(max(1, int(rank.max(initial=0)).bit_length())):
        prefix = rank >> (bit + 1)
        order = np.argsort(prefix, kind="stable")
        one, start = (rank[order] >> bit) & 1, np.searchsorted(prefix[order], prefix[order])
        ones = np.concatenate(([0], np.cumsum(one)))
        total += int(((ones[:-1] - ones[start])[one == 0]).sum())
    return total


def _tau(x: np.ndarray, y: np.ndarray) -> tuple[float | None, int]:
    """(tau-b, number of pairs) in n log n steps."""
    ties = lambda *keys: sum(int(c) * (int(c) - 1) // 2 for c in np.unique(np.stack(keys, 1), axis=0, return_counts=True)[1])
    pairs = len(x) * (len(x) - 1) // 2
    same_x, same_y, same = ties(x), ties(y), ties(x, y)
    rank = np.unique(y, return_inverse=True)[1][np.lexsort((y, x))]
    p, q = pairs - same_x, pairs - same_y
    both = pairs - same_x - same_y + same - 2 * _inversions(rank)
    return (both / float(np.sqrt(float(p) * float(q))) if p and q else None), pairs


def kendall(pairs: DataFrame, group: str | list[str], x: str, y: str, key: str | None = None) -> DataFrame:
    """(group, tau, n): tau-b of each group's rows and the number of its pairs; null where a side is constant, nulls left out. No key of the rows is needed; one may be named.

    A group's two columns are one task's, as numbers in Arrow; groups without a pair have no row.
    """
    groups = [group] if isinstance(group, str) else group
    rows = pairs.select(*groups, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null")

    def run(key, table):
        tau, n = _tau(table["_x"].to_numpy(), table["_y"].to_numpy())
        return pa.table({**{g: pa.array([k.as_py()], table.schema.field(g).type) for g, k in zip(groups, key)}, "tau": pa.array([tau], pa.float64()), "n": pa.array([n], pa.int64())})

    schema = StructType([*rows.schema.fields[: len(groups)], StructField("tau", DoubleType()), StructField("n", LongType())])
    return rows.groupBy(*groups).applyInArrow(run, schema).where("n > 0")


def bins(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    """rows with ``bin``: n right-closed bins of equal width over the column's range, from 1; the least value is in the first."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / n
    place = F.greatest(F.lit(1), F.ceil((F.col(column) - F.col("_lo")) / width)).cast("int")
    return rows.crossJoin(F.broadcast(ends)).withColumn("bin", place).drop("_lo", "_hi")  # one row


def average_rank_share(rows: DataFrame, group: str, value: str) -> DataFrame:
    """rows with ``pct``: rank within the group over its size, ties with their average rank. Equal values are counted together and ranked over ranges, so a group of any size is spread over tasks."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("_ties"))
    upto = running(counts, group, [value], {"_upto": ("sum", "_ties")})
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_size"))  # a row a group
    shares = upto.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).select(F.col(group).alias("_g"), F.col(value).alias("_v"), ((F.col("_upto") - (F.col("_ties") - 1) / 2) / F.col("_size")).alias("pct"))
    return rows.join(shares, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def _ranked(rows: DataFrame, group: str, key: str, score: str) -> DataFrame:
    """rows with i, the place from 0 by score from the highest, and n, the size of the group."""
    order = Window.partitionBy(group).orderBy(F.desc(score), key)
    return rows.withColumns({"i": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(group))})


def representatives(rows: DataFrame, group: str, key: str, score: str) -> DataFrame:
    """(group, key, kind): the five best (high), the five last of over five (low), and of over ten five from the middle third (medium).

    Of six to ten, high and low may name one row twice in the definition; a row is named once here, high first.
    """
    i, n = F.col("i"), F.col("n")
    third, end = F.floor(n / 3), F.least(F.floor(n / 3) + 5, F.floor(2 * n / 3))
    kind = F.when(i < 5, "high").when((n > 5) & (i >= n - 5), "low").when((n > 10) & (i >= third) & (i < end), "medium")
    return _ranked(rows, group, key, score).select(group, key, kind.alias("kind")).where("kind is not null")


def diverse_sample(rows: DataFrame, group: str, key: str, score: str) -> DataFrame:
    """(group, key): of ten or more the three best, the three last and four from the middle third; of five or more two, two and the middle one; else all."""
    i, n = F.col("i"), F.col("n")
    third, end = F.floor(n / 3), F.least(F.floor(n / 3) + 4, F.floor(2 * n / 3))
    many = (n >= 10) & ((i < 3) | (i >= n - 3) | ((i >= third) & (i < end)))
    some = (n >= 5) & (n < 10) & ((i < 2) | (i >= n - 2) | (i == F.floor(n / 2)))
    return _ranked(rows, group, key, score).where((n < 5) | many | some).select(group, key)


def front_polyline(trials: DataFrame, study: str = "study") -> DataFrame:
    """(study, x, y): the front by rising v1 as a staircase; between two points the middle of the step, its corner, and the middle of the rise."""
    order = Window.partitionBy(study).orderBy("v1")
    rows = pareto_front(trials, study).withColumns({"a": F.lead("v0").over(order), "b": F.lead("v1").over(order)})
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    v0, v1, a, b = (F.col(c) for c in ("v0", "v1", "a", "b"))
    here = F.array(point(v0, v1))
    steps = F.when(a.isNull(), here).otherwise(F.concat(here, F.array(point((v0 + a) / 2, v1), point(a, v1), point(a, (v1 + b) / 2))))
    return rows.select(study, F.explode(steps).alias("p")).select(study, "p.x", "p.y")


def cumulative_area(trials: DataFrame, study: str = "study") -> DataFrame:
    """(study, number, area): the Pareto area of each study's trials up to each one, in the limits of the whole study.

    One pass over a study's trials in order: the front so far is kept sorted, and a new trial adds the part of its box that
    the front leaves, so a study of n trials with fronts of f points takes n log f steps plus the points it removes. A
    study's trials are one task's, read in Arrow batches; they are as many as the study has run.
    """
    import bisect

    import pandas as pd

    limits = trials.groupBy(study).agg(F.percentile("v0", 0.1).alias("y0"), F.max("v0").alias("y1"), F.min("v1").alias("x0"), F.percentile("v1", 0.9).alias("x1"))
    rows = trials.select(study, "number", "v0", "v1").where("v0 is not null and v1 is not null").join(F.broadcast(limits), study)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        y0, y1, x0, x1 = (float(pdf[c].iloc[0]) for c in ("y0", "y1", "x0", "x1"))
        xs, ys, total, out = [], [], 0.0, []  # the front: x and y both rise
        for v0, v1 in zip(pdf["v0"].astype(float), pdf["v1"].astype(float)):
            x, y = max(x0, min(x1, v1)), max(y0, min(y1, v0))
            at = bisect.bisect_right(xs, x)
            base = ys[at - 1] if at else y0
            if y > base:
                level, left, end = base, x, at
                while end < len(xs) and ys[end] <= y:
                    total += (xs[end] - left) * (y - level)
                    level, left, end = ys[end], xs[end], end + 1
                total += ((xs[end] if end < len(xs) else x1) - left) * (y - level)
                start = at - 1 if at and xs[at - 1] == x else at
                xs[start:end], ys[start:end] = [x], [y]
            out.append(total)
        whole = (x1 - x0) * (y1 - y0)
        return pd.DataFrame({study: pdf[study], "number": pdf["number"], "area": [t / whole if whole else None for t in out]})

    kinds = dict(trials.dtypes)
    return rows.groupBy(study).applyInPandas(run, f"{study} {kinds[study]}, number {kinds['number']}, area double")


def study_matrix(trials: DataFrame, setting: str, value: str, study: str = "study") -> DataFrame:
    """(study_a, study_b, tau): rank correlation of the medians of shared settings for every two studies of three or more pairs; 0 for a study itself."""
    medians = trials.groupBy(study, setting).agg(F.median(value).alias("v"))
    a, b = medians.select(F.col(study).alias("study_a"), setting, F.col("v").alias("x")), medians.select(F.col(study).alias("study_b"), setting, F.col("v").alias("y"))
    found = kendall(a.join(b, setting).where("study_a <> study_b"), ["study_a", "study_b"], "x", "y").where("n >= 3").drop("n")
    return found.union(trials.select(F.col(study).alias("study_a"), F.col(study).alias("study_b"), F.lit(0.0).alias("tau")).distinct())


def kneedle(trials: DataFrame, study: str = "study", sensitivity: float = 1.0) -> DataFrame:
    """The knee of each front by its difference curve: the first local peak of y - x, both on 0..1, after which the curve falls under the peak less
    sensitivity times the mean step of x before it rises again; the last peak if none falls so far; none for fronts of under three points."""
    whole, order = Window.partitionBy(study), Window.partitionBy(study).orderBy("v1")
    scale = lambda c: F.try_divide(F.col(c) - F.min(c).over(whole), F.max(c).over(whole) - F.min(c).over(whole))
    rows = pareto_front(trials, study).withColumns({"d": scale("v0") - scale("v1"), "n": F.count(F.lit(1)).over(whole)})
    rows = rows.withColumns({"before": F.lag("d").over(order), "after": F.lead("d").over(order), "place": F.row_number().over(order)})
    peak = (F.col("n") >= 3) & (F.col("d") >= F.coalesce("before", F.lit(-2.0))) & (F.col("d") >= F.coalesce("after", F.lit(-2.0)))
    rows = rows.withColumn("peak", F.coalesce(peak, F.lit(False)))
    run = F.count_if("peak").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("run", run).where("run > 0")
    own = Window.partitionBy(study, "run")
    rows = rows.withColumns({"top": F.max(F.when(F.col("peak"), F.col("d"))).over(own), "low": F.min("d").over(own)})
    falls = F.col("low") < F.col("top") - sensitivity / (F.col("n") - 1)
    peaks = rows.where("peak").withColumn("falls", falls)
    best = Window.partitionBy(study).orderBy(F.desc("falls"), F.when(F.col("falls"), F.col("place")), F.desc("place"))
    return peaks.withColumn("r", F.row_number().over(best)).where("r = 1").select(study, "number", "v0", "v1", F.round("d", 9).alias("rise"))


def ucb(nodes: DataFrame, c: float = 1.414) -> DataFrame:
    """nodes(node, parent, visits, value_sum) with ucb: mean value + c * sqrt(ln parent's visits / visits); infinite without visits.

    A root, or a node whose parent has no visits, has its mean value.
    """
    above = nodes.select(F.col("node").alias("_node"), F.col("visits").alias("_above"))
    mean = F.col("value_sum") / F.col("visits")
    score = F.when(F.col("visits") == 0, F.lit(float("inf"))).when(F.coalesce("_above", F.lit(0)) == 0, mean).otherwise(mean + c * F.sqrt(F.log("_above") / F.col("visits")))
    return nodes.join(above, F.col("parent") == F.col("_node"), "left").withColumn("ucb", score).drop("_node", "_above")
