"""Loaders, insights and parameters on small tables with nulls and ties."""

from pyspark.sql import functions as F

from lumenqa.operators import memory, order
from lumenqa.sources import tables


def test_search_results_with_gaps(spark):
    rows = [("q", "a", 1, None, [("x", 1), ("y", 2), ("x", 3), (None, 4)]), ("q", None, 2, "simple", None), ("q", "a", 3, None, [])]
    raw = spark.createDataFrame(rows, "query string, answer string, interaction_id long, question_type string, search_results array<struct<_hash:string,n:int>>")
    got = {r["id"]: r for r in tables.search_result_records(raw).collect()}
    assert got["1"]["context"] == {"y": '{"_hash":"y","n":2}', "x": '{"_hash":"x","n":3}'}
    assert got["2"]["context"] == {} == got["3"]["context"] and got["2"]["qtype"] == "simple" and got["1"]["qtype"] == "default"


def test_evidence_and_plain_records(spark):
    raw = spark.createDataFrame([(7, "q", "a", None, None, None, "<p>")], "key long, question string, answer string, evidence string, justification string, question_type string, html_evidence string")
    one = tables.evidence_records(raw, "key").first()
    assert (one["id"], one["context"], one["supporting_facts"], one["qtype"], one["gold_evidence"]) == ("7", {}, [], "default", "<p>")
    plain = tables.plain_records(spark.createDataFrame([(1, "q", None)], "id long, question string, answer string")).first()
    assert plain["id"] == "1" and plain["answer"] is None and plain["context"] == {}


def test_insights_by_membership(spark):
    insights = spark.createDataFrame(
        [("i1", 1, "t1", "d" * 301, "r", 0.5, ["a", "b", "a"]), ("i2", 2, "t2", "short", "r", 0.25, ["a"]), ("i3", 3, "t3", "x", "r", 1.0, ["a"]), ("i4", 0, "t4", "x", "r", 1.0, None)],
        "insight_id string, discovered int, title string, description string, recommendation string, confidence double, supporting_config_ids array<string>",
    )
    configs = spark.createDataFrame([("a",), ("b",), ("c",)], "config_id string")
    assert {(r["config_id"], r["insight_id"]) for r in memory.linked_insights(configs, insights).collect()} == {("a", "i1"), ("a", "i2"), ("a", "i3"), ("b", "i1")}
    texts = {r["config_id"]: r["digest"] for r in memory.insight_digest(configs, insights).collect()}
    assert set(texts) == {"a", "b"} and "d" * 300 + "..." in texts["b"] and "t3" not in texts["a"] and "Confidence: 0.25" in texts["a"]


def test_best_path_breaks_ties(spark):
    nodes = spark.createDataFrame([(1, None, 9), (2, 1, 5), (3, 1, 5), (4, 2, 0), (5, 3, 8), (6, None, 1)], "node long, parent long, visits long")
    assert sorted(tuple(r) for r in memory.best_path(nodes, 9).collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 4), (6, 0, 6)]
    assert memory.best_path(nodes, 1).count() == 3


def test_mergeable(spark):
    rows = [(i, i / 8, None if i % 3 else True, None if i % 2 else "t", 1) for i in range(24)]
    df = spark.createDataFrame(rows, "n int, x double, flag boolean, text string, same int")
    out, kept = memory.mergeable(df, ["n", "x", "flag", "text", "same"], 4)
    first, last = out.orderBy(F.col("n")).first(), {r["n"] for r in out.collect()}
    assert kept == ["n", "x", "flag", "text"] and last == {"(0, 5]", "(5, 11]", "(11, 17]", "(17, 23]"} and first["same"] == "1"
    assert {r["flag"] for r in out.collect()} == {"True", "False"} and {r["text"] for r in out.collect()} == {"t", "N/A"}
    strict, _ = memory.mergeable(df, ["x"], 4, strict=True)
    assert {"0.125", "0", "1", "2.875"} <= {r["x"] for r in strict.collect()}


def test_tiles_as_ntile(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 11), ("b", 3), ("c", 8)) for i in range(n)], "g string, i int")
    got = order.tiles(df, "g", ["i"], 4)
    assert got.select("g", "i", "tile").exceptAll(df.selectExpr("g", "i", "cast(ntile(4) over (partition by g order by i) as int) as tile")).count() == 0 and got.count() == 22
