"""Chunking, BM25, vector search, fusion and context assembly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stems import stem_table
from . import blocks as B
from .order import cut


def chunk_tokens(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, text): windows of ``size`` blank-separated words, each starting size - overlap after the one before."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda x: x != "")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1 - overlap, F.lit(0)), F.lit(step))
    rows = docs.select(key, words.alias("w")).where(F.size("w") > 0).select(key, "w", F.posexplode(starts).alias("chunk", "start"))
    return rows.select(key, "chunk", F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("text"))


#: Distinct query words that are sent to all tasks; beyond it, postings are joined with them by a shuffle.
MAX_SENT_WORDS = 200_000

#: Pairs of a query and a word that are sent to all tasks.
MAX_SENT_PAIRS = 2_000_000

#: Pairs of a query and a document, and documents, that one task of bm25 scores; with more of them there are more tasks.
PAIRS_A_TASK = 1_000_000
DOCS_A_TASK = 10_000


def _tasks(docs: DataFrame, queries: DataFrame) -> int:
    """Tasks among which documents are dealt, so that what a task holds doesn't grow with their number."""
    n, least = docs.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-n * queries.count() // PAIRS_A_TASK), -(-n // DOCS_A_TASK))


def bm25(queries: DataFrame, docs: DataFrame, k: int, query: str = "item_id", key: str = "doc_id", k1: float = 1.2, b: float = 0.75, stem: bool = False) -> DataFrame:
    """(query, key, score, rank): top k documents of each query by an inverted index of the queries' words, or of their English stems.

    Texts are split once; only words that a query has become postings, and their document frequencies are counted on those.
    The list of a word is joined with the queries that have it, whose number the queries bound. Postings are dealt by document and the queries' words are sent
    to them, up to MAX_SENT_PAIRS, so a document's scores are made where it is and only the k best of each task go on; there are as many tasks as hold PAIRS_A_TASK each. Stems are made once for each distinct word and joined back.
    """
    asked = queries.select(query, F.explode(T.tokens(F.col("text"))).alias("word"))
    split = docs.select(key, T.tokens(F.col("text")).alias("w")).withColumn("length", F.size("w"))
    if stem:
        spoken = cut(stem_table(asked.select("word")))
        wanted = asked.join(spoken, "word").select(query, "term").distinct()
        every = stem_table(split.select(F.explode("w").alias("word")))
        words = cut(every.join(spoken.select("term").distinct(), "term", "left_semi").select("word", "term"))  # used more than once
    else:
        wanted = asked.withColumnRenamed("word", "term").distinct()
        words = wanted.select(F.col("term").alias("word"), "term").distinct()
    stats = docs.select(F.size(T.tokens(F.col("text"))).alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    sent = F.broadcast(words) if words.count() <= MAX_SENT_WORDS else words
    postings = split.select(key, "length", F.explode("w").alias("word")).join(sent, "word").repartition(_tasks(docs, queries), key).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    asking = cut(wanted.join(frequency, "term"))
    hits = postings.join(F.broadcast(asking) if asking.count() <= MAX_SENT_PAIRS else asking, "term").crossJoin(F.broadcast(stats))  # stats is one row
    scored = hits.groupBy(query, key).agg(F.sum(idf * weight).alias("score"))
    return top_k(scored, query, key, k)


def top_k(scored: DataFrame, query: str, key: str, k: int, score: str = "score") -> DataFrame:
    """Rows of the k best keys of each query with their rank; scores are compared to 9 digits, ties go to the smaller key."""
    order = Window.partitionBy(query).orderBy(F.desc(F.round(score, 9)), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) by exact cosine of queries(query_id, query) with base(vec_id, embedding), in blocks; an id is no hit of itself."""
    hits = B.best_pairs(queries.select("query_id", "query").dropna(), base.select("vec_id", "embedding").dropna(), k).toDF("query_id", "vec_id", "score")
    return top_k(hits, "query_id", "vec_id", k)


def fuse(hits: DataFrame, mode: str, k: int, query: str = "item_id", key: str = "doc_id", weight: Column | float = 1.0) -> DataFrame:
    """(query, key, score, rank) from hits(query, key, list, score, rank).

    simple: the largest score; reciprocal_rerank: sum of 1 / (60 + rank); relative_score: sum of scores on the scale of
    their list's least and largest; dist_based_score: the same with mean -+ 3 population deviations, held to 0..1. What a hit adds is multiplied by its weight.
    """
    one = Window.partitionBy(query, "list")
    lo, hi = F.min("score").over(one), F.max("score").over(one)
    if mode == "dist_based_score":
        mean, dev = F.avg("score").over(one), F.stddev_pop("score").over(one)
        lo, hi = mean - 3 * dev, mean + 3 * dev
    scaled = F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") - lo) / (hi - lo)))).otherwise(1.0)
    value: Column = {"simple": F.col("score"), "reciprocal_rerank": 1 / (60 + F.col("rank")), "relative_score": scaled, "dist_based_score": scaled}[mode]
    total = F.max("value") if mode == "simple" else F.sum("value")
    rows = hits.withColumn("value", value * weight).groupBy(query, key).agg(total.alias("score"))
    return top_k(rows, query, key, k)


def dedup(hits: DataFrame, k: int, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(query, key, score, rank) from hits(query, key, place, score): each key once, as in the list of the smallest place."""
    return top_k(hits.groupBy(query, key).agg(F.min_by("score", "place").alias("score")), query, key, k)


def fuse_subqueries(hits: DataFrame, k: int, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(query, key, score, weighted, rank): best weighted score over sub-queries, weight 1 - 0.1 * place; the unweighted score stays."""
    weighted = F.col("score") * (1 - 0.1 * F.col("sub"))
    rows = hits.withColumn("weighted", weighted).groupBy(query, key).agg(F.max("weighted").alias("weighted"), F.max_by("score", "weighted").alias("score"))
    return top_k(rows, query, key, k, "weighted")


def contexts(hits: DataFrame, query: str = "item_id") -> DataFrame:
    """(query, context): ``Context i:`` and the text of each hit by rank; empty texts are left out but keep their number."""
    line = F.concat(F.lit("Context "), F.col("rank").cast("string"), F.lit(":\n"), F.col("text"))
    rows = hits.where(F.trim("text") != "").groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return rows.select(query, F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("context"))


def neighbours(chunks: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Each chunk with the text of those up to k before and after it."""
    window = Window.partitionBy(key).orderBy("chunk").rowsBetween(-k, k)
    return chunks.select(key, "chunk", F.array_join(F.collect_list("text").over(window), " ").alias("context"))


def max_sim(tokens: DataFrame) -> DataFrame:
    """(query_label, label, score) of tokens(vec_id, label, embedding): each label's tokens as a query against each label's as a document.

    The score is the mean over all query tokens of their largest dot product with the document's.
    """
    return max_sim_of(tokens, tokens)


def max_sim_of(queries: DataFrame, tokens: DataFrame) -> DataFrame:
    """max_sim with query tokens of their own; every pair is scored in blocks, and a block keeps the best of each token and label."""

    def score(a, b):
        dots = a["embedding"] @ b["embedding"].T
        labels, at = np.unique(b["label"], return_inverse=True)
        best = np.full((len(dots), len(labels)), -np.inf)
        for i in range(len(labels)):
            best[:, i] = dots[:, at == i].max(1)
        n = len(labels)
        return np.repeat(a["label"], n), np.repeat(a["vec_id"], n), np.tile(labels, len(dots)), best.ravel()

    rows = lambda x: x.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").dropna()
    best = B.pairs(rows(queries), rows(tokens), score, "query_label long, q long, label long, best double")
    best = best.groupBy("query_label", "q", "label").agg(F.max("best").alias("best"))
    return best.groupBy("query_label", "label").agg((F.sum("best") / F.count(F.lit(1))).alias("score"))
