import datetime
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lumenqa.functions import scoring
from lumenqa.operators import blocks as B
from lumenqa.operators import configs as C
from lumenqa.operators import graphs, retrieval, selection, splitters, vector_index
from lumenqa.operators.retrieval import bm25
from lumenqa.plans import catalogue
from test_studies import likeness


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL on tables given as columns."""
    base = duckdb.connect()
    for t, columns in tables.items():
        path = f"{folder}/{t}.parquet"
        pq.write_table(pa.table(columns), path)
        base.execute(f"create view {t} as select * from '{path}'")
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, str(folder)).collect()]
    return sorted(map(repr, got)), sorted(map(repr, base.execute(catalogue.ORACLES[name]).fetchall()))


def test_similar_configs_of_copies_and_negative_numbers(spark):
    """Copies are scored once, yet each is named; two negative numbers are more than alike, so sharing no text is no bar."""
    r = random.Random(8)
    rows = []
    for i in range(90):
        one = {c: r.choice("abc") + str(i % 2) if i % 3 else None for c in C.SAME} | {c: r.choice([4, 5, 9, -1, -40] if i < 60 else [4, 5]) for c in C.RELATIVE} | {c: r.choice([0.0, 0.3]) for c in C.ABSOLUTE} | {c: r.choice([True, False, None]) for c in C.FLAGS}
        rows.append({"config_id": i, **one})
    rows += [{**rows[i % 7], "config_id": 100 + i} for i in range(60)]
    kinds = ", ".join([*(f"{c} string" for c in C.SAME), *(f"{c} int" for c in C.RELATIVE), *(f"{c} double" for c in C.ABSOLUTE), *(f"{c} boolean" for c in C.FLAGS)])

    def holds(rows, over):
        df = spark.createDataFrame([tuple(x.values()) for x in rows], "config_id long, " + kinds)
        got = {}
        for x in C.similar_configs(df, 3, over).collect():
            got[x["config_id"], x["rank"]] = x["other"]
        want = {}
        for a in rows:
            best = sorted((-likeness(a, b), b["config_id"]) for b in rows if b is not a and likeness(a, b) > over)[:3]
            want |= {(a["config_id"], i + 1): b for i, (_, b) in enumerate(best)}
        assert got == want

    holds(rows, -1.0)
    holds([x for x in rows if min(x[c] for c in C.RELATIVE) > 0], 0.5)
    holds([x for x in rows if min(x[c] for c in C.RELATIVE) > 0], -1.0)


def test_numbered_list_parse_of_odd_texts(spark, tmp_path):
    texts = [None, "", "one item\n\u00a0wide item \u3000\nx", "\x0bvertical tab", "tab\t1. inner", "a" * 6 + "\r\n\r\n  indented item  ", "\u2003em blank\u2003\n\x0b  after it", "1) twice numbered\n* starred"]
    got, want = against_sql(spark, tmp_path, "numbered_list_parse", documents={"doc_id": list(range(len(texts))), "text": texts})
    assert got == want


def test_study_load_of_exact_halves(spark, tmp_path):
    """Microseconds of a study whose hours end in exact halves of the last digit."""
    start = datetime.datetime(2024, 1, 1)
    n = 3000
    events = {
        "event_id": list(range(n)), "ts": [start + datetime.timedelta(microseconds=1800 * (2 * i * 7919 + 1) * (i > 0)) for i in range(n)], "user_id": [i % 97 for i in range(n)],
        "event_type": ["view"] * n, "value": [i / 7 for i in range(n)], "props": ["{}"] * n,
    }
    got, want = against_sql(spark, tmp_path, "study_load", events=events)
    assert got == want


def test_insight_relations_of_equal_sets_and_many_sizes(spark):
    """Keys of several words: as many for sets of five words as pairs share, and every size meets every other that can."""
    assert C._bands([5], 0.3) == [(5, 5, 3, 3)]
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdefghijklmnopqrst") + r.choice("12") for _ in range(r.choice([1, 2, 3, 5, 7, 9, 12, 18, 40])))) for i in range(120)]
    rows += [(200 + i, " ".join(reversed(rows[i % 40][1].split()))) for i in range(80)]
    sets = {i: set(t.split()) for i, t in rows}
    for over in (0.3, 0.6):
        got = sorted((x["older"], x["newer"], round(x["strength"], 9)) for x in C.insight_relations(spark.createDataFrame(rows, "insight_id long, description string"), over).collect())
        share = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
        assert got == sorted((i, j, round(s, 9)) for (i, j), s in share.items() if s > over)


def test_bm25_scores_are_made_where_the_document_is(spark):
    queries = spark.createDataFrame([(1, "red apple"), (2, "green pear")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "a red red apple"), (11, "pear and apple"), (12, None)], "doc_id long, text string")
    found = bm25(queries, docs, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(item_id#\d+L?, doc_id", plan)
    assert sorted((r["item_id"], r["doc_id"], r["rank"]) for r in found.collect()) == [(1, 10, 1), (1, 11, 2), (2, 11, 1)]


def test_best_columns_leave_out_what_is_no_number():
    scores = np.tile(np.arange(20.0), (2, 1))
    scores[:, 15:] = np.nan
    assert [x.tolist() for x in B.best_columns(scores, np.arange(20), 3)] == [[0, 0, 0, 1, 1, 1], [14, 13, 12, 14, 13, 12]]


def test_sampled_graph_scores_few_pairs(spark, monkeypatch):
    """Nodes whose partners are no near ones by a part of the rows aren't scored against all of them."""
    r, scored = np.random.default_rng(4), []
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.standard_normal((1500, 24)))], "vec_id long, embedding array<double>").repartition(4).cache()
    dense = retrieval.dense
    want = {(x["query_id"], x["vec_id"]) for x in dense(vectors.select(*[vectors[c].alias(n) for c, n in (("vec_id", "query_id"), ("embedding", "query"))]), vectors, 3).collect()}

    def counted(queries, base, k):
        scored.append(queries.count() * base.count())
        return dense(queries, base, k)

    monkeypatch.setattr(retrieval, "dense", counted)
    monkeypatch.setattr(selection, "FIRST_TIER", 150, raising=False)
    monkeypatch.setattr(selection, "TIER_STEP", 3, raising=False)
    edges = {(x["u"], x["v"]) for x in selection.sampled_graph(vectors, 2.0, 8, 3).collect()}
    assert sum(scored) < 1500 * 1500 // 2
    drawn = {i: [(i + 1 + j * selection.DRAW_STEP % 1499) % 1500 for j in range(11)] for i in range(1500)}
    kept = {(u, v) for u, vs in drawn.items() for v in [v for v in vs if (u, v) not in want][:8]}
    assert edges == {(min(p), max(p)) for p in kept}


def test_near_pairs_of_ties_and_repeated_ids(spark, monkeypatch):
    """Equal vectors, ties to the smaller id, an id twice: in tiers as against all rows."""
    r = random.Random(6)
    kinds = [[r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] for _ in range(40)]
    data = [(i, kinds[i % 40 if i % 3 else 0]) for i in range(300)] + [(i, kinds[i % 7]) for i in range(30)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    near = {(x["query_id"], x["vec_id"]) for x in retrieval.dense(rows.toDF("query_id", "query"), rows, 4).collect()}
    unit = lambda x: np.array(x) / max(np.linalg.norm(x), 1e-300)
    pairs = [(u, v, float(unit(x) @ unit(y))) for u, x in data for v, y in data if u != v and (u * 31 + v) % 3 == 0]
    monkeypatch.setattr(selection, "FIRST_TIER", 20)
    monkeypatch.setattr(selection, "TIER_STEP", 2)
    got = selection.near_pairs(spark.createDataFrame(pairs, "u long, v long, cos double"), rows, 4).collect()
    assert sorted((x["u"], x["v"]) for x in got) == sorted({(u, v) for u, v, _ in pairs} & near)


def test_degrees_and_parts_without_edge_rows(spark, monkeypatch):
    """Weights, numbers and parts of the dissimilarity graph against its edges; its queries don't make any."""
    r = np.random.default_rng(2)
    data = np.concatenate([r.standard_normal((70, 3)), np.abs(r.standard_normal((20, 3))), np.zeros((2, 3))])
    vectors = spark.createDataFrame([(i * 3 % 101, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(B.own_pairs, "__defaults__", (None, 9))
    monkeypatch.setattr(B, "HELD", 20)
    for below in (-0.9, -0.2, 0.3):
        edges = [(x["u"], x["v"], x["w"]) for x in selection.dissimilarity_graph(vectors, below).collect()]
        unit = B.unit(data)
        assert sorted((u, v) for u, v, _ in edges) == sorted((min(p), max(p)) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T < below, 1))) for p in [(i * 3 % 101, j * 3 % 101)])
        want = {}
        for u, v, w in edges:
            for x in (u, v):
                want[x] = (want.get(x, (0, 0))[0] + w, want.get(x, (0, 0))[1] + 1)
        got = {x["node"]: (x["degree"], x["links"]) for x in selection.dissimilarity_degrees(vectors, below).collect()}
        assert got.keys() == want.keys() and all(abs(got[x][0] - want[x][0]) < 1e-9 and got[x][1] == want[x][1] for x in got)
        nodes = vectors.select(vectors["vec_id"].alias("node"))
        parts = selection.dissimilarity_parts(vectors, below).collect()
        frame = lambda rows: spark.createDataFrame(rows, "u long, v long")
        assert sum(x["links"] for x in parts) == len(edges) and abs(sum(x["weight"] for x in parts) - sum(w for _, _, w in edges)) < 1e-9
        assert graphs.connected_parts(frame([(x["u"], x["v"]) for x in parts]), nodes).exceptAll(graphs.connected_parts(frame([(u, v) for u, v, _ in edges]), nodes)).isEmpty()

    def none(*_):
        raise AssertionError("edges became rows")

    monkeypatch.setattr(selection, "dissimilarity_graph", none)
    for name in ("greedy_peeling", "subgraph_density", "selected_subgraph_report"):
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 1


def test_stars_of_chains():
    u, v = selection._stars(np.array([5, 9, 7, 30, 40, 8]), np.array([9, 7, 3, 31, 40, 3]))
    assert sorted(zip(u.tolist(), v.tolist())) == [(3, 5), (3, 7), (3, 8), (3, 9), (30, 31)]


def test_bm25_deals_documents_by_number(spark, monkeypatch):
    """More documents are more tasks, whatever the number of shuffle partitions, so that a task's table of pairs doesn't grow."""
    queries = spark.createDataFrame([(i, "red apple") for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "a red apple " * (i % 3 + 1)) for i in range(100)], "doc_id long, text string")
    want = sorted(map(tuple, bm25(queries, docs, 3).collect()))
    monkeypatch.setattr(retrieval, "PAIRS_A_TASK", 50, raising=False)
    found = bm25(queries, docs, 3)
    assert re.search(r"hashpartitioning\(doc_id#\d+L?, 10\)", found._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, found.collect())) == want


def test_pieces_go_on_before_a_batch_ends(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    texts = ["One. Two here. " * (i % 5) for i in range(40)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(42), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    whole = list(splitters._pieces(docs, splitters.sentences, "doc_id", "text")([batch]))
    monkeypatch.setattr(splitters, "HELD", 100, raising=False)
    made = list(splitters._pieces(docs, splitters.sentences, "doc_id", "text")([batch]))
    assert max(sum(map(len, m["text"].to_pylist())) for m in made) < 160
    assert pa.Table.from_batches(made).to_pylist() == pa.Table.from_batches(whole).to_pylist()


def test_queries_are_sent_in_bounded_parts(spark, monkeypatch):
    r = np.random.default_rng(1)
    centroids = B.unit(r.standard_normal((50, 8)))
    index = vector_index.VectorIndex(centroids, None, 30, np.ones(50, int), np.ones(50))
    queries = spark.createDataFrame([(1, [0.0])], "query_id long, query array<double>")
    batch = pa.RecordBatch.from_arrays([pa.array(range(90), pa.int64()), pa.array(r.standard_normal((90, 8)).tolist())], ["query_id", "query"])
    monkeypatch.setattr(type(queries), "mapInArrow", lambda self, run, schema: run)
    whole = list(vector_index._sent(index, queries, 0, 30)([batch]))
    monkeypatch.setattr(vector_index, "SENT", 500, raising=False)
    made = list(vector_index._sent(index, queries, 0, 30)([batch]))
    assert max(m.num_rows for m in made) <= 500 and sum(m.num_rows for m in made) == 90 * 30
    ids = lambda batches: pa.Table.from_batches(batches).select(["list", "query_id"]).to_pylist()
    assert ids(made) == ids(whole)


def test_model_scores_are_compiled(spark):
    """No array and no lambda a line, and the same numbers as from arrays."""
    plan = catalogue.QUERIES["model_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "array(" not in plan
    x, y = F.lit(1.25), F.lit(-0.5)
    kinds = ("single", "sigmoid", "last", "last_log", "difference", "first")
    pairs = [(scoring.relevance(F.array(x, y), k), scoring.relevance([x, y], k)) for k in kinds] + [(scoring.divergence(F.array(y, x), F.array(x, y)), scoring.divergence([y, x], [x, y]))]
    assert spark.range(1).select(*[a == b for a, b in pairs]).first() == (True,) * 7


def test_config_relations_are_the_sql_s_to_the_last_digit(spark, tmp_path):
    """Parts whose likeness is a half of the last digit but for the order in which weights are added, and parts without a price."""
    names = ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"]
    found = duckdb.sql(f"select {', '.join(names)} from '/root/testdata/sf0.1/part.parquet' where p_partkey in (5611, 7109, 4942, 7911, 8965, 8977, 5458, 11974)").fetchall()
    rows = found + [(20000 + part, brand, kind, size, None) for part, brand, kind, size, _ in found[:2]]
    got, want = against_sql(spark, tmp_path, "config_relations", part=dict(zip(names, map(list, zip(*rows)))))
    assert got == want and len(want) > 4 and any("None" in r for r in want)


def test_config_relations_below_what_needs_a_shared_value(spark):
    r = random.Random(9)
    rows = [{"config_id": i, "created": i % 5, "avg_f1_score": float(i)} | {c: r.choice(["a", "b", "c", None]) for c in C.SAME} | {c: r.choice([3, 5, 9, None]) for c in C.RELATIVE} | {c: r.choice([0.0, 0.25, None]) for c in C.ABSOLUTE} | {c: r.choice([True, False]) for c in C.FLAGS} for i in range(40)]
    kinds = ", ".join([*(f"{c} string" for c in C.SAME), *(f"{c} int" for c in C.RELATIVE), *(f"{c} double" for c in C.ABSOLUTE), *(f"{c} boolean" for c in C.FLAGS)])
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "config_id long, created int, avg_f1_score double, " + kinds)
    order = lambda x: (x["created"], x["config_id"])
    want = sorted((a["config_id"], b["config_id"], likeness(a, b)) for a in rows for b in rows if order(a) < order(b) and likeness(a, b) > 0.3)
    assert sorted((x["older"], x["newer"], round(x["similarity"], 9)) for x in C.config_relations(df, 0.3).collect()) == want


def test_one_group_of_configurations_is_scored_by_many_tasks(spark):
    n = 2100
    rows = [(i, i % 7, float(i), str(i), "same", str(i), str(i // 3), True, True, True) for i in range(n)]
    df = spark.createDataFrame(rows, "config_id long, created int, avg_f1_score double, " + ", ".join(f"{c} string" for c in C.SAME) + ", " + ", ".join(f"{c} boolean" for c in C.FLAGS))
    df = df.withColumns({c: F.lit(None).cast("double") for c in (*C.RELATIVE, *C.ABSOLUTE)})
    got = C.config_relations(df).withColumn("task", F.spark_partition_id()).collect()
    want = sorted(tuple(sorted((i, j), key=lambda x: (x % 7, x))) for i in range(n) for j in range(i + 1, i // 3 * 3 + 3))
    assert sorted((r["older"], r["newer"]) for r in got) == want and {r["similarity"] for r in got} == {0.51}
    assert len({r["task"] for r in got}) > 1


def test_insight_relations_of_few_words_make_no_keys(spark, monkeypatch):
    """Few words in all: blocks of sets are scored, copies in parts, an id twice is no pair of its own; as by keys of words."""
    r = random.Random(11)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.choice([1, 2, 4, 5, 7]))) for _ in range(40)]
    rows = [(i, texts[i % 40 if i % 3 else 0]) for i in range(150)]
    sets = {i: set(t.split()) for i, t in rows}
    share = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    relations = lambda rows, *more: sorted(map(tuple, C.insight_relations(spark.createDataFrame(rows, "insight_id long, description string"), 0.5, *more).collect()))
    want = sorted((i, j, s) for (i, j), s in share.items() if s > 0.5)
    monkeypatch.setattr(C, "DENSE_WORDS", 0, raising=False)
    assert relations(rows) == want
    monkeypatch.setattr(C, "DENSE_WORDS", 8, raising=False)
    monkeypatch.setattr(C, "MEMBERS", 5, raising=False)
    monkeypatch.setattr(C, "SETS", 16, raising=False)
    monkeypatch.setattr(C, "SENT_PAIRS", 7, raising=False)

    def none(*_):
        raise AssertionError("words became keys")

    monkeypatch.setattr(C, "_bands", none)
    assert relations(rows) == want
    assert relations(rows, 2) == [(i, j, round(s + 1e-9, 2)) for i, j, s in want]
    assert relations([(1, "a b"), (1, "a b"), (1, "b a a c"), (2, "a b"), (None, "a b"), (3, None), (4, " ")]) == [(1, 2, 2 / 3), (1, 2, 1.0), (1, 2, 1.0)]


def test_best_pairs_of_cells(spark, monkeypatch):
    """The k best in either direction as by plain numbers: ties, copies, an id twice, vectors that are zero or no numbers; a cell gives k rows a row at most, and nothing goes by the driver."""
    r = np.random.default_rng(7)
    data = np.concatenate([r.standard_normal((60, 4)), np.repeat(r.standard_normal((3, 4)), 12, 0), r.choice([-1.0, 0.0, 1.0], (40, 4)), np.zeros((2, 4)), np.full((2, 4), np.nan)])
    ids = [i * 37 % 140 for i in range(len(data) - 1)] + [5]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, data)], "vec_id long, embedding array<double>")
    cosine = B.unit(data) @ B.unit(data).T
    monkeypatch.setattr(B, "SIDE", 2)
    for apart in (False, True):
        found = B.best_pairs(rows, rows, 3, apart, 16)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        got, want = {}, {}
        for x in found.withColumn("task", F.spark_partition_id()).collect():
            got.setdefault(x["a"], set()).add((-round(x["score"], 9), x["b"]))
        for i, a in enumerate(ids):
            scores = [(-round(1 - c if apart else c, 9), b) for c, b in zip(cosine[i], ids) if b != a and c == c]
            want.setdefault(a, set()).update(sorted(scores)[:3])
        for a, best in want.items():
            near = sorted(got.get(a, ()))[: len(best)]
            assert [b for _, b in near] == [b for _, b in sorted(best)] if ids.count(a) == 1 else best <= got[a]
            assert all(abs(x - y) < 2e-9 for (x, _), (y, _) in zip(near, sorted(best))) or ids.count(a) > 1


def test_best_of_a_block_is_scored_in_double_only_where_it_must():
    """A bound of the k-th best settles nearly all pairs of later blocks; close scores are told apart beyond single precision."""
    r = np.random.default_rng(5)
    block = lambda x, first: (np.arange(len(x)) + first, B.unit(x), B.unit(x).astype(np.float32))
    mine = block(r.standard_normal((50, 8)), 0)
    base = mine[1][0]
    close = np.array([base + np.eye(8)[1] * 1e-4 * (1 + j * 1e-4) for j in range(30)])
    yours = [block(x, 1000 * i + 1000) for i, x in enumerate([r.standard_normal((200, 8)), r.standard_normal((200, 8)), close])]
    a, b, score = B._best_of(mine, yours, 4, False)
    for i in range(50):
        every = [(-round(float(mine[1][i] @ v), 9), n) for ids, vectors, _ in yours for n, v in zip(ids.tolist(), vectors)]
        assert b[a == i].tolist() == [n for _, n in sorted(every)[:4]]


def test_sampled_graph_sends_no_table_by_the_driver(spark, monkeypatch, tmp_path):
    """Vectors, drawn pairs and the nearest meet by merge joins; only the sizes of ranges, a row a partition, are broadcast."""
    r, plans, cut = np.random.default_rng(4), [], selection._cut

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(selection, "_cut", kept)
    monkeypatch.setattr(selection, "FIRST_TIER", 20)
    monkeypatch.setattr(selection, "TIER_STEP", 2)
    pq.write_table(pa.table({"vec_id": list(range(70)), "embedding": r.standard_normal((70, 6)).tolist()}), f"{tmp_path}/v.parquet")
    vectors = spark.read.parquet(f"{tmp_path}/v.parquet")  # a file's size is known, so that a join may broadcast it
    plans.append(selection.sampled_graph(vectors, 2.0, 8, 3)._jdf.queryExecution().executedPlan().toString())
    joins = [p for p in plans if "_before" not in p]
    assert len(joins) > 3 and not [p for p in joins if "Broadcast" in p]
