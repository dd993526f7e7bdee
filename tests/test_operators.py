import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenqa.operators import retrieval as R
from lumenqa.operators import selection as S
from lumenqa.operators import trials as T
from lumenqa.sources import tables
from lumenqa.streaming.rollup import windowed_average


def trials(spark, rows):
    return spark.createDataFrame([("s", i, float(a) if a is not None else None, float(b) if b is not None else None) for i, (a, b) in enumerate(rows)], "study string, number long, v0 double, v1 double")


def test_pareto_against_brute_force(spark):
    r = random.Random(3)
    points = [(r.randint(0, 9), r.randint(0, 9)) for _ in range(60)] + [(None, 1), (float("inf"), 0)]
    got = {x["number"] for x in T.pareto_front(trials(spark, points)).collect()}
    good = [(i, a, b) for i, (a, b) in enumerate(points[:-2])]
    want = {i for i, a, b in good if not any((c >= a and d <= b and (c, d) != (a, b)) or ((c, d) == (a, b) and j < i) for j, c, d in good)}
    assert got == want


def test_pareto_edges(spark):
    assert T.pareto_front(trials(spark, [])).count() == 0
    assert T.pareto_front(trials(spark, [(1, 1), (1, 1)])).count() == 1
    assert 0 <= T.pareto_area(trials(spark, [(1, 1), (2, 2), (3, 5)])).first()["area"] <= 1


def test_kendall(spark):
    df = spark.createDataFrame([("g", i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (2, 2), (3, 3), (3, 4)])], "g string, i long, x double, y double")
    assert T.kendall(df, "g", "x", "y", "i").first()["tau"] == pytest.approx(5 / 30**0.5)


def test_bins_and_ranks(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (0, 1, 5, 10, 10)], "g string, x double")
    assert [r["bin"] for r in T.bins(df, "x").orderBy("x").collect()] == [1, 1, 5, 10, 10]
    assert [r["pct"] for r in T.average_rank_share(df, "g", "x").orderBy("x").collect()] == pytest.approx([0.2, 0.4, 0.6, 0.9, 0.9])


def test_chunks_cover(spark):
    words = " ".join(map(str, range(100)))
    docs = spark.createDataFrame([(1, words), (2, ""), (3, None), (4, "one")], "doc_id long, text string")
    got = {}
    for r in R.chunk_tokens(docs, 30, 10).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).append(r["text"].split())
    assert set(got) == {1, 4} and got[4] == [["one"]]
    assert sorted({int(w) for c in got[1] for w in c}) == list(range(100)) and all(a[-10:] == b[:10] for a, b in zip(got[1], got[1][1:]))


def test_fusion(spark):
    hits = spark.createDataFrame([(1, 10, "a", 3.0, 1), (1, 11, "a", 1.0, 2), (1, 11, "b", 5.0, 1)], "item_id long, doc_id long, list string, score double, rank int")
    scores = lambda mode: {r["doc_id"]: r["score"] for r in R.fuse(hits, mode, 5).collect()}
    assert scores("reciprocal_rerank") == pytest.approx({10: 1 / 61, 11: 1 / 62 + 1 / 61})
    assert scores("simple") == {10: 3.0, 11: 5.0}
    assert scores("relative_score") == pytest.approx({10: 1.0, 11: 1.0})


def test_selection(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], i % 3) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    picks = [x["vec_id"] for x in S.max_min(vectors, 6).orderBy("place").collect()]
    assert picks[0] == 0 and len(set(picks)) == 6
    assert len({x["vec_id"] for x in S.submodular(vectors, 6).collect()}) == 6
    assert sum(x["weight"] for x in S.coreset(vectors, 3).collect()) == pytest.approx(1)
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 0.1)], "u long, v long, w double")
    assert {x["node"] for x in S.densest(edges).collect()} == {1, 2, 3}
    assert S.densest(edges.limit(0)).count() == 0


def test_submodular_by_brute_force(spark):
    rng = np.random.default_rng(7)
    x = (rng.normal(0.4, 1, (40, 5)) * rng.uniform(0.1, 9, (40, 1))).astype(np.float32)
    x[11] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-30)
    like = lambda ids: u[ids].mean(0) @ u.mean(0) / np.linalg.norm(u[ids].mean(0)) / np.linalg.norm(u.mean(0))
    for share in (0.5, 0.1):
        chosen = [0]
        while len(chosen) < 8:
            rest = [i for i in range(40) if i not in chosen]
            gain = [share * min(1 - u[i] @ u[j] for j in chosen) + (1 - share) * (like([*chosen, i]) - like(chosen)) for i in rest]
            chosen.append(rest[int(np.argmax(np.round(gain, 9)))])
        assert [r["vec_id"] for r in S.submodular(vectors, 8, share).orderBy("place").collect()] == chosen


def test_lsh_codes(spark):
    x = np.random.default_rng(1).normal(size=(30, 64)).astype(np.float32)
    x[1] = x[0]
    x[1, 1::4] *= -9  # alike in every fourth coordinate
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["code"] for r in S.lsh_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = x.astype(float) @ np.random.RandomState(42).randn(64, 64).T > 0
    assert got == {i: "".join("01"[int(b)] for b in row) for i, row in enumerate(want)} and got[0] != got[1]


def test_max_sim_uses_every_token(spark):
    x = np.random.default_rng(2).normal(size=(60, 8)).astype(np.float32)
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)]
    got = {(r["query_label"], r["label"]): r["score"] for r in R.max_sim(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    dots = x.astype(float) @ x.astype(float).T
    assert got == {(a, b): pytest.approx(dots[a::3, b::3].max(1).mean()) for a in range(3) for b in range(3)}


def test_sources(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text('{"id": "1", "query": "q", "answer_ground_truth": "x", "text_ground_truth": ["d2", "d9", "d1"]}\nbroken\n{"query": "r"}\n')
    raw = tables.read_records(spark, str(tmp_path / "qa.jsonl"), "id string, query string, answer_ground_truth string, text_ground_truth array<string>")
    corpus = spark.createDataFrame([("d1", "one"), ("d2", "two")], "id string, text string")
    got = {r["id"]: list(r["evidence"]) for r in tables.with_evidence(tables.qa_records(raw, "set"), corpus).collect()}
    assert got.pop("1") == ["two", "one"] and list(got.values()) == [[]]
    (tmp_path / "run.txt").write_text("q1 Q0 p1 1 9.5 x\n")
    assert tuple(tables.read_trec(spark, str(tmp_path / "run.txt")).first()) == ("q1", "p1", 1, 9.5)
    with pytest.raises(ValueError):
        tables.write_records(corpus, str(tmp_path / "x.txt"))


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) as ts, 'view' as event_type, cast(id as double) as value from range(100)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_average(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("rolled")) == key(windowed_average(rows))
    assert F is not None
