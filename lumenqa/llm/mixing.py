"""Operator 6: mix sources to target weights by repeating whole documents.

Tokens are added up by source; a source's rate is its target over its tokens; each document goes out floor(rate) times,
and once more with the rate's fraction as probability, by a uniform number hashed from its id and a seed. For each source, all SEEDS seeds are tried in
one pass over (id, size), and the one whose copies come nearest to the target is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

SEEDS = 48
#: Sources whose plan is broadcast; beyond it, the plan is joined by a shuffle.
MAX_SENT_SOURCES = 100_000
_PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class MixParams:
    """weights repeat along the sources in code point order, null last; max_rate is the most that a source repeats."""

    weights: tuple[int, ...] = (1, 2, 3)
    max_rate: int = 3


def word_count(text: Column) -> Column:
    """The number of maximal runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int | Column) -> Column:
    """A number in [0, 1) from the id and a seed, by arithmetic modulo a prime that any SQL engine has; null counts as 0."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    prime = F.lit(_PRIME).cast("long")
    x = F.pmod(F.coalesce(doc_id.cast("long"), F.lit(0)), prime)
    a = (x * F.lit(48271).cast("long") + (seed + 1) * F.lit(1234577).cast("long")) % prime
    b = (a * a + a * F.lit(3).cast("long") + seed) % prime
    return ((b * b + F.lit(16807).cast("long") * b + 7) % prime) / F.lit(float(_PRIME))


def draw_key(doc_id: Column, text: Column) -> Column:
    """What a row is drawn by: its id, or where that is null, 48 bits of its text's MD5, so that rows without an id are drawn apart."""
    digest = F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 12), 16, 10)
    return F.coalesce(doc_id.cast("long"), digest.cast("long"))


def targets(sizes: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """(source, source_size, target): shares by weight of the whole, none above max_rate times its source's size.

    The level at which a source is full is max_rate * size / weight; the sources with the lowest levels are full, and
    what is left is shared by weight, so the water level follows from running sums over one small row for each source.
    """
    places = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weights = F.array(*[F.lit(w).cast("long") for w in p.weights])
    rows = sizes.withColumn("w", F.element_at(weights, (places % len(p.weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * p.max_rate)
    everything, order = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order), F.lit(0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(order), F.lit(0))
    rows = rows.withColumn("level", left / weight).withColumn("full", F.col("cap") / F.col("w"))
    level = F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(everything)
    return rows.select("source", "source_size", F.least(F.col("w") * F.coalesce(level, F.col("full")), F.col("cap").cast("double")).alias("target"))


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with what their source has; the table of sources is sent to all tasks only where its size allows."""
    sources = F.broadcast(sources) if sources.count() <= MAX_SENT_SOURCES else sources
    return rows.join(sources, F.col("source").eqNullSafe(F.col("_source")))


def source_plan(rows: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """(_source, source_size, target, rate, seed), one row a source of rows(draw_key, source, size); without words the rate is 0."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = cut(targets(sizes, p).withColumn("rate", rate).withColumnRenamed("source", "_source"))
    extra = [F.sum(F.when(draw(F.col("draw_key"), k) < F.col("rate") - F.floor("rate"), F.col("size")).otherwise(0)) for k in range(SEEDS)]
    tried = _with_sources(rows, aims).groupBy("_source", "source_size", "target", "rate").agg(F.array(*extra).alias("extra"))
    miss = F.transform("extra", lambda x: F.abs(x + F.floor("rate") * F.col("source_size") - F.col("target")))
    return cut(tried.select("_source", "source_size", "target", "rate", (F.array_position(miss, F.array_min(miss)) - 1).cast("long").alias("seed")))


def copies() -> Column:
    """How often a row that has its source's plan goes out."""
    more = draw(F.col("draw_key"), F.col("seed")) < F.col("rate") - F.floor("rate")
    return (F.floor("rate") + F.when(more, 1).otherwise(0)).cast("long")


def mix_report(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs(doc_id, source, text, ...).

    Null and empty texts have size 0, a null source is a source, rows that repeat a doc_id are drawn alike, those without one by their text; of
    seeds that come equally near the target the first is taken; texts of any length are counted whole; an empty table gives no rows.
    """
    rows = cut(docs.select("doc_id", draw_key(F.col("doc_id"), F.col("text")).alias("draw_key"), "source", word_count(F.col("text")).alias("size")))
    out = _with_sources(rows, source_plan(rows, p))
    return out.select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"))


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """docs with every row as often as the mix takes it; the columns stay, whatever else they are called.

    Nulls, ties, repeated rows and very long texts count as in mix_report; an empty table stays empty.
    """
    names = docs.columns
    key = draw_key(F.col("doc_id"), F.col("text")).alias("draw_key")
    rows = cut(docs.select(key, "source", word_count(F.col("text")).alias("size")))
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")  # keeps clear of names that clash
    planned = _with_sources(docs.select(key, "source", whole), source_plan(rows, p))
    return planned.where(copies() > 0).select("row", F.explode(F.sequence(F.lit(1), copies().cast("int")))).select("row.*")
