"""Operators on studies, configurations, blocks and parsing against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenqa.functions import parsing as P
from lumenqa.functions import text as T
from lumenqa.operators import configs as C
from lumenqa.operators import order, retrieval, selection, studies, trials


def vectors(n, seed=1):
    return np.random.RandomState(seed).randn(n, 6)


def frame(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in row], i % 3) for i, row in enumerate(matrix)], "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("size", [7, 1024])
def test_blocks(spark, monkeypatch, size):
    from lumenqa.operators import blocks

    monkeypatch.setattr(blocks.blocks, "__defaults__", (size,))
    monkeypatch.setattr(blocks.pairs, "__defaults__", (size,))
    m = vectors(40).astype(np.float32).astype(float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cosine, df = unit @ unit.T, frame(spark, m)
    got = selection.dissimilarity_graph(df, 0.1).collect()
    assert {(r["u"], r["v"]) for r in got} == {(i, j) for i in range(40) for j in range(i + 1, 40) if cosine[i, j] < 0.1}
    queries = df.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.dense(queries, df, 3).collect()}
    for i in range(5):
        assert [near[i, k] for k in (1, 2, 3)] == sorted((j for j in range(40) if j != i), key=lambda j: -cosine[i, j])[:3]
    far = {(r["vec_id"], r["label"]): r["bound"] for r in selection.farthest_in_clusters(df).collect()}
    bound = {(r["vec_id"], r["label"]): r["bound"] for r in selection.cluster_bounds(df, 3).collect()}
    for i, t in itertools.product(range(40), range(3)):
        assert far[i, t] == pytest.approx(max(np.linalg.norm(m[i] - m[j]) for j in range(40) if j % 3 == t), abs=1e-6) and bound[i, t] >= far[i, t] - 1e-6


def test_sampled_graph(spark):
    m = vectors(60)
    df = frame(spark, m)
    edges = selection.sampled_graph(df, 2.0, 10, 5).collect()
    degree = {}
    for r in edges:
        assert r["u"] < r["v"]
        degree[r["u"]] = degree.get(r["u"], 0) + 1
        degree[r["v"]] = degree.get(r["v"], 0) + 1
    assert len({(r["u"], r["v"]) for r in edges}) == len(edges) and min(degree.values()) >= 10
    assert selection.sampled_graph(df.limit(1), 2.0, 10, 5).count() == 0


def test_dalkss(spark):
    dense = [(a, b, 1.0) for a in range(6) for b in range(a + 1, 6)]
    sparse = [(a, a + 1, 0.1) for a in range(10, 30)]
    edges = spark.createDataFrame(dense + sparse, "u long, v long, w double")
    assert {r["node"] for r in selection.dalkss(edges, 4).collect()} == set(range(6))
    assert selection.dalkss(edges, 8).count() >= 8 and {*range(6)} <= {r["node"] for r in selection.dalkss(edges, 8).collect()}


def likeness(a, b):
    total = 0.0
    for name, w in {**C.SAME, **C.FLAGS}.items():
        total += w * (a[name] is not None and a[name] == b[name])
    for name, w in C.RELATIVE.items():
        x, y = a[name], b[name]
        if x is not None and y is not None:
            total += w * (1 if x == y else max(0, 1 - abs(x - y) / max(x, y)) if x and y else 0)
    for name, w in C.ABSOLUTE.items():
        x, y = a[name], b[name]
        if x is not None and y is not None:
            total += w * (1 if abs(x - y) < 0.01 else max(0, 1 - 2 * abs(x - y)))
    return round(total, 9)


def test_config_relations(spark):
    r = random.Random(5)
    rows = []
    for i in range(60):
        one = {c: r.choice(["a", "b", None]) for c in C.SAME} | {c: r.choice([0, 3, 5, None]) for c in C.RELATIVE} | {c: r.choice([0.0, 0.1, 0.105, 0.9, None]) for c in C.ABSOLUTE} | {c: r.choice([True, False]) for c in C.FLAGS}
        rows.append({"config_id": i, "created": i % 7, "avg_f1_score": i / 10, **one})
    kinds = ", ".join([*(f"{c} string" for c in C.SAME), *(f"{c} int" for c in C.RELATIVE), *(f"{c} double" for c in C.ABSOLUTE), *(f"{c} boolean" for c in C.FLAGS)])
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "config_id long, created int, avg_f1_score double, " + kinds)
    assert sum({**C.SAME, **C.RELATIVE, **C.ABSOLUTE, **C.FLAGS}.values()) == pytest.approx(1)
    want = {}
    for a, b in itertools.permutations(rows, 2):
        if (a["created"], a["config_id"]) < (b["created"], b["config_id"]) and likeness(a, b) > 0.5:
            want[a["config_id"], b["config_id"]] = (likeness(a, b), round(b["avg_f1_score"] - a["avg_f1_score"], 9))
    got = {(x["older"], x["newer"]): (x["similarity"], round(x["delta"], 9)) for x in C.config_relations(df).collect()}
    assert got == want and 20 < len(want) < 60 * 59 / 2
    top = {(x["config_id"], x["rank"]): x["other"] for x in C.similar_configs(df, 3).collect()}
    for a in rows:
        order_of = sorted((b for b in rows if b is not a), key=lambda b: (-likeness(a, b), b["config_id"]))
        assert [top[a["config_id"], k] for k in (1, 2, 3)] == [b["config_id"] for b in order_of[:3]]


def test_insight_relations(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("abcdefghijk") for _ in range(r.randint(0, 9)))) for i in range(50)]
    got = {(x["older"], x["newer"]): round(x["strength"], 9) for x in C.insight_relations(spark.createDataFrame(rows, "insight_id long, description string")).collect()}
    sets = {i: set(t.split()) for i, t in rows}
    assert got == {(i, j): round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 9) for i in sets for j in sets if i < j and sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.3}


def test_places(spark):
    df = spark.createDataFrame([(i * 7919 % 101, i) for i in range(101)], "a long, b long").repartition(5)
    assert sorted((r["a"], r["place"]) for r in order.with_place(df, "a").collect()) == [(i, i) for i in range(101)]
    assert sorted(r["place"] for r in order.with_input_place(df).collect()) == list(range(101))


def test_cumulative_area(spark):
    r = random.Random(9)
    rows = [("s", i, float(r.randint(0, 9)), float(r.randint(0, 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "study string, number long, v0 double, v1 double")
    whole = trials.pareto_area(df).first()["area"]
    got = [x["area"] for x in trials.cumulative_area(df).orderBy("number").collect()]
    assert got == sorted(got) and got[-1] == pytest.approx(whole)


def test_picks_of_small_groups(spark):
    rows = [(f"g{n}", i, float(-i)) for n in (1, 4, 5, 6, 9, 10, 11, 30) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, s double")
    kinds, some = {}, {}
    for x in trials.representatives(df, "g", "id", "s").collect():
        kinds.setdefault(x["g"], {}).setdefault(x["kind"], set()).add(x["id"])
    for x in trials.diverse_sample(df, "g", "id", "s").collect():
        some.setdefault(x["g"], set()).add(x["id"])
    assert kinds["g5"] == {"high": {0, 1, 2, 3, 4}} and kinds["g6"] == {"high": {0, 1, 2, 3, 4}, "low": {5}}
    assert kinds["g30"] == {"high": {0, 1, 2, 3, 4}, "low": {25, 26, 27, 28, 29}, "medium": {10, 11, 12, 13, 14}}
    assert some["g4"] == {0, 1, 2, 3} and some["g5"] == {0, 1, 2, 3, 4} and some["g9"] == {0, 1, 4, 7, 8} and some["g30"] == {0, 1, 2, 10, 11, 12, 13, 27, 28, 29}


def test_bins(spark):
    df = spark.createDataFrame([(float(i) / 3, i % 4, "x" * 40) for i in range(60)] + [(None, None, None)], "a double, b int, c string")
    a = {r["a_binned"]: r["n"] for r in studies.binned(df, "a").groupBy("a_binned").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(a.values()) == 61 and a["N/A"] == 1 and len(a) == 11
    assert {r["b_binned"] for r in studies.binned(df, "b").collect()} == {"0", "1", "2", "3", "N/A"}
    assert {len(r["c_binned"]) for r in studies.binned(df, "c").collect()} == {29, 3}


def test_text_to_bool_refuses(spark):
    with pytest.raises(Exception, match="neither yes nor no"):
        spark.createDataFrame([("maybe",)], "a string").select(studies.text_to_bool(F.col("a"))).collect()


def test_kneedle(spark):
    df = spark.createDataFrame([("s", i, y, float(i)) for i, y in enumerate([0.0, 6.0, 8.0, 9.0, 9.5, 9.8])] + [("t", 9, 1.0, 1.0)], "study string, number long, v0 double, v1 double")
    assert [(r["study"], r["number"]) for r in trials.kneedle(df).collect()] == [("s", 2)]


CASES = [
    ("Question: What is the capital of France?\nAnswer: Paris", "Paris"), ("Based on the context.\n\nAnswer: The capital is Paris.", "The capital is Paris"),
    ("这是一个复杂的问题。\n\n答案: 巴黎是法国的首都。", "巴黎是法国的首都。"), ("Let me think.\n\nA: 42", "42"), ("Simple answer without any markers", "Simple answer without any markers"),
    ('(CompletionResponse(text="so. Answer: Rome. And more", additional_kwargs={}))', "Rome"), ('(CompletionResponse(text="just this.", additional_kwargs={}))', "just this"),
    ("Answer: x, additional_kwargs={'a': 1}", "x"), ("Answer: 'quoted'\nExplanation: why", "quoted"), ("", ""), (None, None),
]


def test_extract_answer(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, a string")
    got = {r["i"]: r["x"] for r in df.select("i", T.extract_answer(F.col("a")).alias("x")).collect()}
    assert [got[i] for i in range(len(CASES))] == [b for _, b in CASES]


def test_labels(spark):
    df = spark.createDataFrame([("short",), ("a/" + "b" * 40,), ("long/path/of/many/parts/with/name",)], "a string")
    assert [r[0] for r in df.select(P.truncate_label(F.col("a"))).collect()] == ["short", "b" * 13 + "..." + "b" * 13, "name"]
