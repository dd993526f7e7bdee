from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenqa.functions import text as T
from lumenqa.functions.text import _longest_common


def values(spark, rows, *columns):
    df = spark.createDataFrame(rows, "a string, b string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_normalize(spark):
    cases = {"": "", "...": "", "the a an": "", "a-b": "ab", "x  y": "x y", "L'été, The End": "lété end", None: None, "Quéa an": "quéa"}
    got = values(spark, [(k, None) for k in cases], T.normalize(F.col("a")))
    assert [g[0] for g in got] == list(cases.values())


def test_token_f1_and_match(spark):
    rows = [("", ""), ("x", ""), ("", "x"), ("x x y", "x y y"), ("cat", "dog"), ("The cat.", "cat"), (None, None)]
    f1 = [r[0] for r in values(spark, rows, T.token_f1(F.col("a"), F.col("b")))]
    assert f1 == pytest.approx([1, 0, 0, 2 / 3, 0, 1, 1])
    assert values(spark, [("The cat.", "cat")], T.exact_match(F.col("a"), F.col("b"))) == [(1.0,)]


def test_f1_and_match_extract_the_answer(spark):
    rows = [
        ("The reasoning is long. Answer: Paris", "Paris"), ("Paris\n\nIt lies on the Seine.", "paris"), ("答案: Paris\nExplanation: so", "Paris"), ('Answer: "The Paris."\nReasoning: x', "Paris"),
        ("Paris\n--- sources", "Paris"), ("Answer: Paris\nQuestion: where", "Paris"), ("Answer: Paris, additional_kwargs={}", "Paris"), ("so a: New Paris", "Paris"), ("Answer:", ""), (None, "x"),
    ]
    got = values(spark, rows, T.exact_match(F.col("a"), F.col("b")), T.token_f1(F.col("a"), F.col("b")))
    assert got == [(1, 1)] * 7 + [(0, pytest.approx(2 / 3)), (1, 1), (None, 0)]


def test_sets_coverage_faithfulness(spark):
    em, f1 = T.set_scores(T.tokens(F.col("a")), T.tokens(F.col("b")))
    assert values(spark, [("", ""), ("x", ""), ("x y", "y x"), ("x y", "y z")], em, f1) == [(1, 1), (0, 0), (1, 1), (0, 0.5)]
    assert values(spark, [("x y z", "y x"), ("x", ""), ("x", "q")], T.coverage(F.col("a"), F.col("b")), T.faithfulness(F.col("a"), F.col("b"))) == [(1, 2 / 3), (0, 0), (0, 0)]


def test_extraction_and_parsing(spark):
    rows = [("Answer: Paris.", None), ("The capital is Paris.", None), ('x\nA: "Rome"\n\nExplanation: y', None), ("答案: 北京。", None)]
    assert [r[0] for r in values(spark, rows, T.extract_answer(F.col("a")))] == ["Paris", "The capital is Paris", "Rome", "北京。"]
    assert values(spark, [("[3] > [1] > [9]", None), ("none", None)], T.ranking(F.col("a"), F.lit(3))) == [([2, 0],), ([0, 1, 2],)]
    scores = values(spark, [("Predict_Score: 0.2 Predict_Score: 80", None), ("", None), ("Predict_Score: 0.4", None)], T.predicted_score(F.col("a")))
    assert [s[0] for s in scores] == pytest.approx([0.8, 0.5, 0.4])
    assert values(spark, [("1. first thing\n- other thing\n2) no\nplain", None)], T.numbered_items(F.col("a"))) == [(["first thing", "other thing"],)]
    assert values(spark, [("When did he die", None), ("where is", None), ("Are both", None), ("", None)], T.question_type(F.col("a"))) == [("temporal_death",), ("location",), ("comparison",), ("other",)]
    assert values(spark, [("abcdef", None), ("ab", None)], T.truncate(F.col("a"), 3)) == [("abc...",), ("ab",)]


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_longest_common(p, g):
    table = [[0] * (len(g) + 1) for _ in range(len(p) + 1)]
    for i, x in enumerate(p):
        for j, y in enumerate(g):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert _longest_common(p, g) == table[-1][-1]


def test_f1_is_the_multiset_one(spark):
    rows = [("x x y z", "x y y"), ("p q", "q p p")]
    for (a, b), (got,) in zip(rows, values(spark, rows, T.token_f1(F.col("a"), F.col("b")))):
        same = sum((Counter(a.split()) & Counter(b.split())).values())
        assert got == pytest.approx(2 * same / (len(a.split()) + len(b.split())))
