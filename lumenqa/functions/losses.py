"""Ranking losses of slates: arrays of predicted and true scores, a null truth for padding, which every loss leaves out.

Each function gives a struct (total, n) for one slate; the loss of many slates is the sum of totals over the sum of n. Definitions
follow the papers: RankNet (Burges et al., 2005), ListNet (Cao et al., 2007), LambdaLoss (Wang et al., 2018).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lambdas import let

#: Fixed value: the least probability under a logarithm.
EPS = 1e-10
SCHEMES = ("none", "ndcg_loss1", "ndcg_loss2", "ndcg_loss2pp", "lambda_rank", "rank_net", "rank_net_gt", "rank_net_gt_squared")


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def slate(pred: Column, truth: Column) -> Column:
    """array<struct(p, t)> of the items that aren't padding, by falling prediction; equal ones in their order."""
    pairs = F.filter(F.arrays_zip(pred.alias("p"), truth.alias("t")), lambda x: x["t"].isNotNull())
    keyed = F.transform(pairs, lambda x, i: F.struct((-x["p"].cast("double")).alias("key"), i.alias("i"), x["t"].cast("double").alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct((-x["key"]).alias("p"), x["t"].alias("t")))


def _result(total: Column, n: Column) -> Column:
    return F.struct(total.alias("total"), n.cast("double").alias("n"))


def rmse(s: Column) -> Column:
    """The root of the slate's mean squared error."""
    squares = F.transform(s, lambda x: (x["t"] - x["p"]) * (x["t"] - x["p"]))
    return _result(F.when(F.size(s) > 0, F.sqrt(_sum(squares) / F.size(s))).otherwise(0.0), (F.size(s) > 0).cast("int"))


def bce(s: Column) -> Column:
    """Binary cross entropy of sigmoid(prediction), item by item; logarithms are at least -100."""
    log = lambda x: F.greatest(F.ln(x), F.lit(-100.0))
    p = lambda x: 1 / (1 + F.exp(-x["p"]))
    q = lambda x: 1 / (1 + F.exp(x["p"]))
    floor = lambda v: F.greatest(v, F.lit(1e-44))  # noqa: E731  ln(0) is null in SQL
    return _result(_sum(F.transform(s, lambda x: -(x["t"] * log(floor(p(x))) + (1 - x["t"]) * log(floor(q(x)))))), F.size(s))


def _softmax(s: Column, field: str) -> Column:
    top = F.array_max(F.transform(s, lambda x: x[field]))
    powers = let(top, lambda top: F.transform(s, lambda x: F.exp(x[field] - top)))
    return let(powers, lambda p: let(_sum(p), lambda total: F.transform(p, lambda e: e / total)))


def list_net(s: Column) -> Column:
    """Cross entropy between the softmax of the truth and that of the predictions."""
    terms = F.zip_with(_softmax(s, "t"), _softmax(s, "p"), lambda t, p: -t * F.ln(p + EPS))
    return _result(F.when(F.size(s) > 0, _sum(terms)).otherwise(0.0), (F.size(s) > 0).cast("int"))


def rank_net(s: Column) -> Column:
    """ln(1 + exp(lower - higher)) of every pair of which one is truly higher."""
    softplus = lambda z: F.greatest(z, F.lit(0.0)) + F.ln(1 + F.exp(-F.abs(z)))
    each = lambda a: F.transform(F.filter(s, lambda b: a["t"] > b["t"]), lambda b: softplus(b["p"] - a["p"]))
    return let(F.flatten(F.transform(s, each)), lambda x: _result(_sum(x), F.size(x)))


def lambda_loss(s: Column, scheme: str = "none", k: int | None = None, sigma: float = 1.0, mu: float = 10.0) -> Column:
    """-log2 of the weighted probability of every pair of the first k places whose first is truly higher; of all pairs for ndcg_loss1."""
    if scheme not in SCHEMES:
        raise ValueError(f"no such scheme: {scheme}")
    discount = lambda place: F.log2(1.0 + place)  # noqa: E731  place from 1
    gain = lambda t: F.pow(F.lit(2.0), F.greatest(t, F.lit(0.0))) - 1
    ideal = F.transform(F.reverse(F.array_sort(F.transform(s, lambda x: x["t"]))), lambda t, i: gain(t) / discount(i + 1))
    best = F.greatest(_sum(F.slice(ideal, 1, k) if k else ideal), F.lit(EPS))
    item = lambda x, i, best: F.struct(x["p"].alias("p"), x["t"].alias("t"), (i + 1).alias("at"), (gain(x["t"]) / best).alias("g"), F.greatest(x["t"], F.lit(0.0)).alias("c"))
    ranked = let(best, lambda best: F.transform(s, lambda x, i: item(x, i, best)))
    ranked = F.slice(ranked, 1, k) if k else ranked

    def near(a: Column, b: Column) -> Column:
        apart = F.abs(a["at"] - b["at"])
        return F.when(apart == 0, F.lit(0.0)).otherwise(F.abs(1 / discount(F.greatest(apart, F.lit(1))) - 1 / discount(apart + 1))) * F.abs(a["g"] - b["g"])

    def swapped(a: Column, b: Column) -> Column:
        return F.abs(1 / discount(a["at"]) - 1 / discount(b["at"])) * F.abs(a["g"] - b["g"])

    weights = {
        "none": lambda a, b: F.lit(1.0),
        "ndcg_loss1": lambda a, b: a["g"] / discount(a["at"]),
        "ndcg_loss2": near,
        "ndcg_loss2pp": lambda a, b: mu * near(a, b) + swapped(a, b),
        "lambda_rank": swapped,
        "rank_net": lambda a, b: F.lit(1.0),
        "rank_net_gt": lambda a, b: F.abs(a["c"] - b["c"]),
        "rank_net_gt_squared": lambda a, b: F.abs(a["c"] * a["c"] - b["c"] * b["c"]),
    }
    weight = weights[scheme]

    def term(a: Column, b: Column) -> Column:
        chance = F.greatest(1 / (1 + F.exp(-sigma * (a["p"] - b["p"]))), F.lit(EPS))
        return -F.log2(F.greatest(F.pow(chance, weight(a, b)), F.lit(EPS)))

    def terms(rows: Column) -> Column:
        others = (lambda a: rows) if scheme == "ndcg_loss1" else (lambda a: F.filter(rows, lambda b: a["t"] > b["t"]))
        return F.flatten(F.transform(rows, lambda a: F.transform(others(a), lambda b: term(a, b))))

    return let(let(ranked, terms), lambda x: _result(_sum(x), F.size(x)))
