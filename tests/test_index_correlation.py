"""Vector index, codebooks, rank correlation and graph reports against brute force."""

import itertools
import random

import numpy as np
import pytest

from lumenqa.operators import correlation, graphs, vector_index
from lumenqa.operators.retrieval import dense

DATA = "/root/testdata/sf0.01"


def vectors(spark, matrix, labels=None):
    return spark.createDataFrame([(i, None if x is None else [float(v) for v in x], int(labels[i]) if labels is not None else 0) for i, x in enumerate(matrix)], "vec_id long, embedding array<double>, label int")


def clustered(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return centres[rng.integers(0, 12, n)] + rng.normal(scale=0.35, size=(n, dims))


def as_queries(base, step=20):
    return base.where(f"vec_id % {step} = 0").selectExpr("vec_id as query_id", "embedding as query")


def pairs(df):
    return {(r["query_id"], r["vec_id"]) for r in df.collect()}


@pytest.mark.parametrize("lists,probes", [(None, None), (30, 2), (1, 1)])
def test_index_recall_and_exactness(spark, lists, probes):
    base = vectors(spark, [*clustered(1500, 16), None, [0.0] * 16]).cache()
    index = vector_index.build(base, vector_index.IndexParams(lists=lists))
    assert index.rows.count() == 1501 == index.sizes.sum()
    exact = dense(as_queries(base), base, 10).cache()
    assert vector_index.recall(vector_index.search(index, as_queries(base), 10), exact) >= 0.9 or probes == 2
    if probes:
        index.probes = probes
    want = sorted((r["query_id"], r["vec_id"], round(r["score"], 6), r["rank"]) for r in exact.collect())
    assert sorted((r["query_id"], r["vec_id"], round(r["score"], 6), r["rank"]) for r in vector_index.search_exact(index, as_queries(base), 10).collect()) == want


def test_index_on_the_table(spark):
    """Recall at 10 of the sf0.01 vectors, with the parameters that the query has."""
    base = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    found = vector_index.search(vector_index.build(base), as_queries(base), 10)
    assert vector_index.recall(found, dense(as_queries(base), base, 10)) >= 0.9


def test_exact_search_leaves_lists_out(spark):
    """Where vectors lie in groups, most lists can't hold a nearer one and aren't visited."""
    base = vectors(spark, clustered(2000, 8, 3))
    index = vector_index.build(base)
    queries = as_queries(base)
    first = vector_index._met(index, vector_index._sent(index, queries, 0, index.probes), 10)
    least = vector_index.top_k(first, "query_id", "vec_id", 10).where("rank = 10").selectExpr("query_id", "score as least")
    rest = vector_index._sent(index, queries.join(least, "query_id", "left"), index.probes).count()
    assert rest < 0.6 * queries.count() * (len(index.sizes) - index.probes)


def test_index_of_nothing(spark):
    empty = vectors(spark, [])
    index = vector_index.build(empty)
    assert vector_index.search(index, as_queries(empty), 3).count() == 0
    one = vectors(spark, [[1.0, 2.0]])
    index = vector_index.build(one)
    assert vector_index.search_exact(index, as_queries(one), 3).count() == 0  # an id is no hit of itself


@pytest.mark.parametrize("subspaces,words,sample", [(3, 4, 50), (1, 300, 1000), (7, 2, 10)])
def test_codebook_bounds_are_bounds(spark, subspaces, words, sample):
    x = clustered(240, 7, 5)
    labels = np.random.default_rng(1).integers(0, 6, len(x))
    got = vector_index.codebook_bounds(vectors(spark, x, labels), subspaces, words, sample).collect()
    assert len(got) == 240 * 6
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    for r in got:
        assert r["bound"] >= far[r["vec_id"], labels == r["label"]].max() - 1e-9
    assert vector_index.codebook_bounds(vectors(spark, [])).count() == 0


# rank correlation


def brute_tau(x, y):
    sign = lambda a, b: (a > b) - (a < b)
    s = p = q = 0
    for (a, c), (b, d) in itertools.combinations(zip(x, y), 2):
        s += sign(a, b) * sign(c, d)
        p += a != b
        q += c != d
    return s / np.sqrt(p * q) if p and q else None


@pytest.mark.parametrize("kinds,n", [(40, 120), (3, 150), (1000, 90), (1, 20)])
def test_tau_b(spark, kinds, n):
    rng = random.Random(kinds)
    rows = [(g, rng.randint(0, kinds) if g != "c" else 5, rng.randint(0, kinds)) for g in "abc" for _ in range(n)] + [("a", None, 3), ("d", 1, None), ("e", 1, 1)]
    got = {r["g"]: r["tau"] for r in correlation.tau_b(spark.createDataFrame(rows, "g string, x int, y int").repartition(5)).collect()}
    assert set(got) == set("abce")
    for g in "abce":
        mine = [(x, y) for k, x, y in rows if k == g and x is not None and y is not None]
        want = brute_tau(*zip(*mine))
        assert got[g] is None if want is None else got[g] == pytest.approx(want, abs=1e-12)


def test_weighted_inversions():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50):
        v, w = rng.integers(0, 9, n), rng.integers(1, 5, n)
        assert correlation.inversions(v, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if v[i] > v[j])


def test_what_correlates(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1.5, 2.5, 3.5, 9.0, 11.0]), rng.choice(["a", "b", None]), rng.choice([True, False]), 7, rng.randint(1, 2), rng.choice([None, 1.0, 2.0, 3.0, 4.0])) for _ in range(150)]
    names = ["params_x", "params_kind", "flag", "same", "two", "score"]
    df = spark.createDataFrame(rows, "params_x double, params_kind string, flag boolean, same int, two int, score double")
    got = {(r["parameter"], r["value"]): (r["correlation"], r["count"], r["strength"]) for r in correlation.what_correlates(df, names[:5], "score").collect()}

    def label(v):
        return str(v)

    want = {}
    for i, name in enumerate(names[:5]):
        column = [r[i] for r in rows]
        if len(set(column)) <= 1:
            want[name, "*"] = (None, sum(v is not None for v in column))
        elif len(set(column)) > 3 and i in (0, 3, 4):
            both = [(v, r[5]) for v, r in zip(column, rows) if v is not None and r[5] is not None]
            want[name, "*"] = (brute_tau(*zip(*both)), sum(v is not None for v in column))
        else:
            for v in set(column):
                hot = [(int(u == v), r[5]) for u, r in zip(column, rows) if r[5] is not None]
                k = sum(u == v for u in column)
                want[name, label(v)] = (brute_tau(*zip(*hot)), min(k, len(rows) - k))
    assert {k[0] for k in got} == {n.replace("params_", "") for n in names[:5]}
    assert len(got) == len(want)
    for (name, value), (tau, count) in want.items():
        mine = got[name.replace("params_", ""), value]
        assert mine[1] == count and (mine[0] is None if tau is None else mine[0] == pytest.approx(tau, abs=1e-12))
        own = [w for k, w in want.items() if k[0] == name]
        strength = None if any(t is None for t, _ in own) else sum(abs(t) * c for t, c in own) / sum(c for _, c in own)
        assert mine[2] is None if strength is None else mine[2] == pytest.approx(strength, abs=1e-12)


# graphs


def test_parts_and_report(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60), rng.random()) for _ in range(45)] + [(i, i + 1, 1.0) for i in range(100, 140)] + [(5, 5, 9.0)]
    edges += [(v, u, w / 2) for u, v, w in edges[:10]]
    chosen = [*range(0, 61, 1), *range(100, 141), 500]
    chosen.remove(120)
    label = {n: n for n in chosen}
    inside = {}
    for u, v, w in edges:
        if u in label and v in label and u != v:
            k = (min(u, v), max(u, v))
            inside[k] = max(w, inside.get(k, 0))
    for _ in chosen:
        for u, v in inside:
            label[u] = label[v] = min(label[u], label[v])
    e, n = spark.createDataFrame(edges, "u long, v long, w double"), spark.createDataFrame([(x,) for x in chosen], "node long")
    assert {r["node"]: r["part"] for r in graphs.connected_parts(e, n).collect()} == label
    r = graphs.subgraph_report(e, n).first()
    parts = [list(label.values()).count(p) for p in set(label.values())]
    size, m = len(chosen), len(inside)
    assert (r["nodes"], r["edges"], r["parts"], r["largest_part"], r["connected"]) == (size, m, len(parts), max(parts), False)
    assert r["weighted_density"] == pytest.approx(sum(inside.values()) / size) and r["density"] == pytest.approx(2 * m / size / (size - 1)) and r["mean_degree"] == pytest.approx(2 * m / size)
    nothing = graphs.subgraph_report(e, n.limit(0)).first()
    assert nothing.asDict() == {"nodes": 0, "edges": 0, "weighted_density": 0.0, "density": 0.0, "mean_degree": 0.0, "connected": False, "parts": 0, "largest_part": 0}
