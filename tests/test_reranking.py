"""Reranking folds, ranking losses and model scores against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenqa.functions import losses, scoring
from lumenqa.operators import reranking


def brute_budget(items, beats, budget, split):
    """items: (key, words, relevant) in order."""
    limit, used, yes, no = int(split[0] * budget), 0, [], []
    for key, words, relevant in items:
        if used + words < limit:
            used += words
            (yes if relevant else no).append(key)
    yes = yes[: int(split[1] * budget)]
    for i in range(len(yes) - 1):
        for j in range(i + 1, len(yes)):
            if (yes[i], yes[j]) in beats:
                yes[i], yes[j] = yes[j], yes[i]
    return [(k, 1.0) for k in yes] + [(k, 0.0) for k in no]


@pytest.mark.parametrize("budget,split,first", [(40, (0.5, 0.5), 50), (100, (1.0, 0.03), 6), (0, (0.5, 0.5), 50)])
def test_budget_rerank(spark, budget, split, first):
    rng = random.Random(budget)
    lists = {q: [(f"d{i}", rng.randint(0, 9), rng.random() < 0.6) for i in range(rng.choice([0, 1, 2, 7, 12]))] for q in range(12)}
    beats = {q: {(a[0], b[0]) for a in x for b in x if a != b and rng.random() < 0.5} for q, x in lists.items()}
    rows = [(q, k, i, w, r) for q, x in lists.items() for i, (k, w, r) in enumerate(x)]
    passages = spark.createDataFrame(rows, "query_id long, doc_id string, place int, words int, relevant boolean")
    preferences = spark.createDataFrame([(q, a, b) for q, x in beats.items() for a, b in x], "query_id long, a string, b string")
    got = reranking.budget_rerank(passages, preferences, budget, split, first)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert found == {q: want for q, x in lists.items() if (want := brute_budget(x[:first], beats[q], budget, split))}


def brute_tournament(scores, size, out, rounds):
    now, rest = list(range(len(scores))), []
    for turn in range(rounds):
        if turn and len(now) <= size:
            break
        won = []
        for s in range(0, len(now), size):
            chunk = now[s : s + size]
            i = 0
            while len(chunk) < size:
                chunk.append(now[i % len(now)])
                i += 1
            won += sorted(chunk, key=lambda x: -scores[x])[:out]
        won = list(dict.fromkeys(won))
        rest = [x for x in now if x not in won] + rest
        now = won
    return now + rest


@pytest.mark.parametrize("size,out,rounds", [(5, 2, 1), (3, 1, 9), (4, 3, 2), (2, 2, 3)])
def test_tournament(spark, size, out, rounds):
    rng = random.Random(size)
    lists = {q: [rng.randint(0, 6) / 2 for _ in range(rng.choice([1, 2, 5, 6, 11, 17]))] for q in range(14)}
    rows = [(q, i, f"d{i}", s) for q, x in lists.items() for i, s in enumerate(x)]
    got = reranking.tournament_rerank(spark.createDataFrame(rows, "query_id long, place int, doc_id string, score double"), size, out, rounds)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert found == {q: [(f"d{i}", x[k]) for k, i in enumerate(brute_tournament(x, size, out, rounds))] for q, x in lists.items()}
    assert reranking.tournament_rerank(spark.createDataFrame([], "query_id long, place int, doc_id string, score double")).count() == 0


def test_training_slates(spark):
    rows = [(1, "a", 0, False, "A"), (1, "b", 1, True, "B"), (1, "c", 2, True, "C"), (1, "b", 3, False, "B again"), (1, "d", 4, None, "D"), (1, "e", 5, False, "E"), (2, "a", 0, False, "none"), (3, "x", 0, True, "X")]
    got = reranking.training_slates(spark.createDataFrame(rows, "query_id long, doc_id string, place int, positive boolean, text string"), 2)
    assert {r["query_id"]: r["slate"] for r in got.collect()} == {1: ["B", "A", "D"], 3: ["X", "<padding_passage>", "<padding_passage>"]}


# losses: numpy versions of the published definitions


def brute_lambda(pred, truth, scheme, k, mu=10.0, sigma=1.0):
    order = sorted(range(len(pred)), key=lambda i: -pred[i])
    p, t = np.array([pred[i] for i in order], float), np.array([truth[i] for i in order], float)
    n = len(p)
    D = np.log2(1 + np.arange(1, n + 1))
    best = max(sum(((2 ** np.sort(t)[::-1] - 1) / D)[:k]), 1e-10)
    G = (2**t - 1) / best
    total, count = 0.0, 0
    for i in range(n):
        for j in range(n):
            if (scheme != "ndcg_loss1" and not t[i] > t[j]) or (k and (i >= k or j >= k)):
                continue
            d = abs(i - j)
            near = 0 if i == j else abs(1 / np.log2(1 + d) - 1 / np.log2(2 + d)) * abs(G[i] - G[j])
            swap = abs(1 / D[i] - 1 / D[j]) * abs(G[i] - G[j])
            w = {"none": 1, "rank_net": 1, "ndcg_loss1": G[i] / D[i], "ndcg_loss2": near, "lambda_rank": swap, "ndcg_loss2pp": mu * near + swap, "rank_net_gt": abs(t[i] - t[j]), "rank_net_gt_squared": abs(t[i] ** 2 - t[j] ** 2)}[scheme]
            total -= math.log2(max(max(1 / (1 + math.exp(-sigma * (p[i] - p[j]))), 1e-10) ** w, 1e-10))
            count += 1
    return total, count


def softmax(x):
    e = np.exp(np.array(x, float) - max(x))
    return e / e.sum()


def test_losses(spark):
    rng = random.Random(1)
    slates = [([rng.uniform(-3, 3) for _ in range(n)], [float(rng.randint(0, 3)) for _ in range(n)]) for n in (1, 2, 5, 9) for _ in range(3)]
    rows = [(i, [*p, 50.0], [*t, None]) for i, (p, t) in enumerate(slates)] + [(99, [], []), (100, [1.0], [None])]
    df = spark.createDataFrame(rows, "id int, p array<double>, t array<double>").withColumn("s", losses.slate(F.col("p"), F.col("t")))
    columns = {"rmse": losses.rmse(F.col("s")), "list_net": losses.list_net(F.col("s")), "rank_net": losses.rank_net(F.col("s"))}
    for k in (None, 3):
        columns |= {f"{scheme} {k}": losses.lambda_loss(F.col("s"), scheme, k) for scheme in losses.SCHEMES}
    got = {r["id"]: r for r in df.select("id", *[c.alias(n) for n, c in columns.items()]).collect()}
    for i, (p, t) in enumerate(slates):
        r = got[i]
        assert r["rmse"]["total"] == pytest.approx(math.sqrt(np.mean((np.array(p) - t) ** 2)), abs=1e-6)
        assert r["list_net"]["total"] == pytest.approx(-(softmax(t) * np.log(softmax(p) + 1e-10)).sum(), abs=1e-6)
        pairs = [math.log1p(math.exp(p[b] - p[a])) for a in range(len(p)) for b in range(len(p)) if t[a] > t[b]]
        assert r["rank_net"]["total"] == pytest.approx(sum(pairs), abs=1e-6) and r["rank_net"]["n"] == len(pairs)
        for k in (None, 3):
            for scheme in losses.SCHEMES:
                total, n = brute_lambda(p, t, scheme, k)
                mine = r[f"{scheme} {k}"]
                assert mine["n"] == n and mine["total"] == pytest.approx(total, abs=1e-6), (scheme, k)
    for i in (99, 100):
        assert all(got[i][n]["total"] == 0 and got[i][n]["n"] == 0 for n in columns)


def test_binary_cross_entropy(spark):
    p, t = [0.0, 3.0, -2.0, 900.0], [1.0, 0.0, 1.0, 0.0]
    got = spark.createDataFrame([(p, t)], "p array<double>, t array<double>").select(losses.bce(losses.slate(F.col("p"), F.col("t"))).alias("x")).first()["x"]
    want = math.log(2) + math.log1p(math.exp(3)) + math.log1p(math.exp(2)) + 100
    assert got["total"] == pytest.approx(want) and got["n"] == 4


# scores


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 3.0], [[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [True, True, False], [-1.0, None, -2.5])], "l array<double>, v array<array<double>>, m array<boolean>, q array<double>")
    l, v, m, q = F.col("l"), F.col("v"), F.col("m"), F.col("q")
    kinds = ("single", "sigmoid", "last", "last_log", "difference", "first")
    r = df.select(
        *[scoring.relevance(l, k).alias(k) for k in kinds], scoring.yes_probability(F.lit(2.0), F.lit(0.0)).alias("yes"), scoring.pooled(v, m).alias("mean"), scoring.pooled(v, mode="first").alias("one"),
        scoring.pooled(v, F.transform(m, lambda x: F.lit(False))).alias("none"), scoring.scaled_dot(l, l).alias("dot"), scoring.divergence(l, F.reverse(l)).alias("kl"), scoring.question_likelihood(q).alias("nll"),
        scoring.question_likelihood(q, F.transform(q, lambda x, i: i == 0)).alias("masked"), scoring.chat_tokens(F.array(F.lit(4), F.lit(None), F.lit(5))).alias("chat"),
    ).first()
    soft = softmax([1, 3])
    want = {"single": 1.0, "sigmoid": 1 / (1 + math.exp(-1)), "last": soft[1], "last_log": math.log(soft[1]), "difference": -2.0, "first": soft[0], "yes": 1 / (1 + math.exp(-2)), "mean": [2.0, 4.0], "one": [1.0, 2.0], "none": [0.0, 0.0], "dot": 10 / math.sqrt(2), "nll": -3.5, "masked": -2.5, "chat": 3 + 7 + 3 + 8}
    for name, x in want.items():
        assert r[name] == pytest.approx(x), name
    gold = softmax([3, 1])
    assert r["kl"] == pytest.approx((gold * np.log(gold / soft)).sum())


def test_costs_inputs_and_hash_embedding(spark):
    rows = [("tokens", 2_000_000, 1_000_000, 0, 0, 1.0), ("characters", 0, 0, 500_000, 0, 1.0), ("hourly", 0, 0, 0, 0, 1800.0), ("other", 1, 1, 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "kind string, ti long, to long, ci long, co long, s double")
    cost = scoring.call_cost(*[F.col(c) for c in ("kind", "ti", "to", "ci", "co", "s")], F.lit(3.0), F.lit(10.0), F.lit(4.0))
    assert [r[0] for r in df.select(cost).collect()] == [16.0, 1.5, 2.0, None]
    texts = spark.createDataFrame([("a b  c d",), ("  ",), (None,)], "t string")
    assert [r[0] for r in texts.select(scoring.embedding_input(F.col("t"), 3, "q: ")).collect()] == ["q: a b c", "q: blank", "q: blank"]
    got = [r[0] for r in texts.select(scoring.hash_embedding("t")).collect()]
    for t, x in zip(["a b  c d", "  ", ""], got):
        assert np.allclose(x, np.random.RandomState(int(hashlib.md5(t.encode()).hexdigest(), 16) % 2**32).normal(0, 1, 384))
    total = spark.createDataFrame([(0, 3, 4), (None, 1, None), (9, 1, 1)], "t int, a int, b int").select(scoring.total_tokens(F.col("t"), F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in total] == [7, 1, 9]
    late = spark.createDataFrame([(10, 100, 5.0, 40.0), (10, 100, 3.0, 40.0), (0, 100, 99.0, 1.0), (100, 100, 99.0, 1.0)], "d int, n int, s double, m double")
    assert [r[0] for r in late.select(scoring.out_of_time(*[F.col(c) for c in "dnsm"])).collect()] == [True, False, False, False]
