"""Scores from model outputs, vectors and prices: expressions over columns that a model or a log fills."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def softmax(logits: Column) -> Column:
    """array<double> that adds up to 1; empty for an empty array."""
    powers = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits)))
    return F.transform(powers, lambda e: e / _sum(powers))


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.ln(_sum(F.transform(logits, lambda x: F.exp(x.cast("double") - top))))
    return F.transform(logits, lambda x: x - top - total)


def yes_probability(yes: Column, no: Column) -> Column:
    """The probability of the first of two answers from their logits."""
    return sigmoid(yes.cast("double") - no)


def _logs(logits: Sequence[Column]) -> list[Column]:
    """log_softmax of so many columns, without arrays."""
    top = F.greatest(*logits)
    total = F.ln(reduce(add, [F.exp(x.cast("double") - top) for x in logits]))
    return [x - top - total for x in logits]


def relevance(logits: Column | Sequence[Column], kind: str) -> Column:
    """A passage's score from its logits: ``single``: the only one as it is; ``sigmoid``: of the only one; ``last``: softmax of the
    last; ``last_log``: its logarithm; ``difference``: the first less the second; ``first``: softmax of the first of two.

    Two or more logits given as columns of their own, rather than an array, make plain expressions, which are compiled.
    """
    if not isinstance(logits, Column):
        power = [F.exp(x.cast("double") - F.greatest(*logits)) for x in logits]
        softmaxed = lambda i: power[i] / reduce(add, power)
        return {
            "single": logits[0].cast("double"), "sigmoid": sigmoid(logits[0]), "last": softmaxed(-1), "last_log": _logs(logits)[-1], "difference": logits[0].cast("double") - logits[1], "first": softmaxed(0),
        }[kind]
    return {
        "single": F.element_at(logits, 1).cast("double"),
        "sigmoid": sigmoid(F.element_at(logits, 1)),
        "last": F.element_at(softmax(logits), -1),
        "last_log": F.element_at(log_softmax(logits), -1),
        "difference": F.element_at(logits, 1).cast("double") - F.element_at(logits, 2),
        "first": F.element_at(softmax(logits), 1),
    }[kind]


def question_likelihood(log_probs: Column, padding: Column | None = None) -> Column:
    """The summed log probability of a question's tokens given a passage; tokens marked as padding don't count, null ones neither."""
    kept = log_probs if padding is None else F.filter(log_probs, lambda x, i: ~F.element_at(padding, i + 1))
    return _sum(F.transform(kept, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))))


def scaled_dot(a: Column, b: Column) -> Column:
    """The dot product over the square root of the number of coordinates."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y)) / F.sqrt(F.size(a))


def pooled(tokens: Column, mask: Column | None = None, mode: str = "mean") -> Column:
    """One vector of array<array<number>>: the ``mean`` of the tokens whose mask is true, or the ``first``; zeros where no token counts."""
    if mode == "first":
        return F.transform(F.element_at(tokens, 1), lambda x: x.cast("double"))
    kept = tokens if mask is None else F.filter(tokens, lambda t, i: F.element_at(mask, i + 1))
    zero = F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def divergence(scores: Column | Sequence[Column], gold: Column | Sequence[Column]) -> Column:
    """Kullback-Leibler divergence of softmax(gold) from softmax(scores) of one query's passages, both arrays or both columns of their own."""
    if not isinstance(gold, Column):
        return reduce(add, [F.exp(g) * (g - s) for g, s in zip(_logs(gold), _logs(scores), strict=True)])
    return _sum(F.zip_with(log_softmax(gold), log_softmax(scores), lambda g, s: F.exp(g) * (g - s)))


def call_cost(kind: Column, tokens_in: Column, tokens_out: Column, characters_in: Column, characters_out: Column, seconds: Column, price_in: Column, price_out: Column, hourly: Column) -> Column:
    """What a call costs: ``tokens`` and ``characters`` by the million on each side, ``hourly`` by its time; null for other kinds."""
    million = lambda a, b: (a.cast("double") * price_in + b.cast("double") * price_out) / 1_000_000
    return F.when(kind == "tokens", million(tokens_in, tokens_out)).when(kind == "characters", million(characters_in, characters_out)).when(kind == "hourly", hourly * seconds / 3600)


def total_tokens(total: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """The total as reported, or what went in and out if that is 0 or null."""
    none = lambda c: F.coalesce(c, F.lit(0))
    return F.when(none(total) == 0, none(tokens_in) + none(tokens_out)).otherwise(total)


def chat_tokens(message_tokens: Column) -> Column:
    """Tokens of a chat from those of its messages (arrays of role and content counts): 3 more a message and 3 for the answer's start."""
    return F.aggregate(message_tokens, F.lit(3).cast("long"), lambda s, n: s + 3 + F.coalesce(n.cast("long"), F.lit(0).cast("long")))


def embedding_input(text: Column, words: int, prefix: str = "") -> Column:
    """What an embedder gets: the first ``words`` blank-separated words after a prefix; "blank" where no word is left."""
    kept = F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), 1, words)
    return F.concat(F.lit(prefix), F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise("blank"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    """384 standard normal numbers drawn with the last 32 bits of the text's MD5 as seed; a null text counts as empty."""
    draw = lambda t: np.random.RandomState(int(hashlib.md5((t or "").encode(), usedforsecurity=False).hexdigest()[-8:], 16)).randn(384)
    return text.map(draw)


def out_of_time(done: Column, total: Column, seconds: Column, limit: Column, least_done: int = 0, least_seconds: float = 0.0) -> Column:
    """Whether work that goes on at its rate so far takes over the limit in all: seconds spent plus seconds a unit times the units left.

    False before more than least_done units or more than least_seconds are spent, without a unit done, and once all are.
    """
    known = (total > 0) & (done > 0) & (done < total) & ((done > least_done) | (seconds > least_seconds))
    return F.coalesce(known & (seconds + seconds / done * (total - done) > limit), F.lit(False))
