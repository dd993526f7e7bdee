"""Conditional spaces of configurations, numbered in mixed radix: counting, decoding, enumerating and sampling without a loop on the driver.

A space is a list of choices; a choice is a name, its values, and the spaces that some values open. A configuration's number has
one digit a choice; within a choice, each value takes as many numbers as the space it opens has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lambdas import let

PARAMS = "map<string,string>"


@dataclass(frozen=True)
class Choice:
    """values as text; opens: value -> the choices that it brings along."""

    name: str
    values: tuple[str, ...]
    opens: dict[str, tuple["Choice", ...]] = field(default_factory=dict)

    def sizes(self) -> list[int]:
        return [cardinality(self.opens.get(v, ())) for v in self.values]


Space = tuple[Choice, ...]


def cardinality(space: Space) -> int:
    """The number of configurations: the product over choices of the sum over values; 1 without choices."""
    return prod(sum(c.sizes()) for c in space)


def _entry(name: str, value: Column | str) -> Column:
    return F.create_map(F.lit(name), value if isinstance(value, Column) else F.lit(value))


def decode(space: Space, number: Column) -> Column:
    """map<string,string>: the configuration of a number from 0 to cardinality - 1; the first choice is the lowest digit."""
    parts, rest = [], number.cast("long")
    for c in space:
        sizes = c.sizes()
        total = sum(sizes)
        digit = rest % total
        if any(v in c.opens for v in c.values):
            parts.append(let(digit, lambda d, c=c, sizes=sizes: _branch(c, sizes, d)))
        else:
            parts.append(_entry(c.name, F.element_at(F.array(*[F.lit(v) for v in c.values]), (digit + 1).cast("int"))))
        rest = F.floor(rest / total).cast("long") if total > 1 else rest
    return F.map_concat(*parts) if len(parts) > 1 else parts[0] if parts else F.create_map().cast(PARAMS)


def _branch(c: Choice, sizes: list[int], digit: Column) -> Column:
    out, start = None, 0
    for value, size in zip(c.values, sizes):
        own = _entry(c.name, value)
        if c.opens.get(value):
            own = F.map_concat(own, decode(c.opens[value], digit - start))
        here = digit < start + size
        out = F.when(here, own) if out is None else out.when(here, own)
        start += size
    return out


def encode(space: Space, params: Column) -> Column:
    """The number of a configuration; null if a value of an open choice is missing or unknown."""
    return let(params, lambda p: _encode(space, p))


def _encode(space: Space, params: Column) -> Column:
    total, weight = F.lit(0).cast("long"), 1
    for c in space:
        digit, start = None, 0
        for value, size in zip(c.values, c.sizes()):
            own = F.lit(start).cast("long")
            if c.opens.get(value):
                own = own + _encode(c.opens[value], params)
            here = params[c.name] == value
            digit = F.when(here, own) if digit is None else digit.when(here, own)
            start += size
        total = total + digit * weight
        weight *= start
    return total


def enumerate_space(spark: SparkSession, space: Space) -> DataFrame:
    """(number, params) of all configurations, each made where its row is."""
    return spark.range(cardinality(space)).select(F.col("id").alias("number"), decode(space, F.col("id")).alias("params"))


def sampled_number(space: Space, key: Column, seed: int) -> Column:
    """A number drawn by a hash of a row's key and a seed, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(cardinality(space)))


def sample(spark: SparkSession, space: Space, n: int, seed: int = 0) -> DataFrame:
    """(draw, number, params) of n draws; every configuration is as likely as any other."""
    number = sampled_number(space, F.col("id"), seed)
    return spark.range(n).select(F.col("id").alias("draw"), number.alias("number")).withColumn("params", decode(space, F.col("number")))


def layers(space: Space, when: str = "") -> Iterator[tuple[str, str, str, int]]:
    """(name, value, condition, configurations below) of each choice's values, in order; the condition names the values that open it."""
    for c in space:
        for value, size in zip(c.values, c.sizes()):
            yield c.name, value, when, size
        for value, more in c.opens.items():
            yield from layers(more, f"{when} and {c.name}={value}" if when else f"{c.name}={value}")


def layer_table(spark: SparkSession, space: Space) -> DataFrame:
    """(place, name, value, condition, configurations) of a space's layers."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(layers(space))], "place int, name string, value string, condition string, configurations long")


def transfer(own: DataFrame, other: DataFrame, space: Space, params: str = "params") -> DataFrame:
    """Trials of another study whose configuration lies in the space and that the own study doesn't have, each configuration once (the smallest number)."""
    known = own.select(encode(space, F.col(params)).alias("_code")).where("_code is not null").distinct()
    coded = other.withColumn("_code", encode(space, F.col(params))).where("_code is not null").join(known, "_code", "left_anti")
    first = coded.groupBy("_code").agg(F.min("number").alias("number"))
    return coded.join(first, ["_code", "number"], "left_semi").dropDuplicates(["_code"]).select(*other.columns)
