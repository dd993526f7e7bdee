"""Reranking of a query's passages by a budget of words, by heats, and by scores of models; all as folds over arrays in the JVM.

A query's list is cut to its first places before it is collected, so no array grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _swapped(items: Column, i: Column, j: Column) -> Column:
    """The array with the items at two places, from 1, exchanged."""
    return F.transform(items, lambda x, k: F.when(k == i - 1, F.element_at(items, j)).when(k == j - 1, F.element_at(items, i)).otherwise(x))


def within_budget(lengths: Column, budget: Column) -> Column:
    """array<boolean>: whether each passage is taken, in order: one whose length keeps the total under the budget, strictly; one that doesn't is skipped and the next tried."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<boolean>").alias("taken"))

    def step(state: Column, n: Column) -> Column:
        fits = state["total"] + n < budget
        return F.struct((state["total"] + F.when(fits, n).otherwise(F.lit(0))).cast("long").alias("total"), F.concat(state["taken"], F.array(fits)).alias("taken"))

    return F.aggregate(lengths, start, step, lambda s: s["taken"])


def bubbled(keys: Column, beats: Column) -> Column:
    """keys after every pair of places i < j, in order of i, then j, has been exchanged if the one at j beats the one at i.

    beats: array of struct(a, b) for which the answer to "a or b?" is b.
    """
    n = F.size(keys)
    places = F.flatten(F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.struct(i.alias("i"), j.alias("j")))))

    def step(now: Column, p: Column) -> Column:
        asked = F.struct(F.element_at(now, p["i"]).alias("a"), F.element_at(now, p["j"]).alias("b"))
        return F.when(F.array_contains(beats, asked), _swapped(now, p["i"], p["j"])).otherwise(now)

    return F.aggregate(places, keys, step)


def budget_rerank(passages: DataFrame, preferences: DataFrame, budget: int, split: tuple[float, float] = (0.5, 0.5), first: int = 50, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, key, rank, score) from passages(query, key, place, words, relevant) and preferences(query, a, b), b preferred to a.

    Of a query's passages with place < first, in order of place, those are judged that fit int(split[0] * budget) words: a passage
    that doesn't fit is skipped. Relevant ones, int(split[1] * budget) at most, are ordered by bubbled() and score 1; the judged
    others follow in their order and score 0. Skipped passages and a query without a judged one have no row; a null
    relevant counts as false, a null words as 0, ties of place go to the smaller key.
    """
    listed = passages.where(F.col("place") < first).select(query, F.struct("place", F.col(key).alias("key"), F.coalesce("words", F.lit(0)).cast("long").alias("words"), F.coalesce("relevant", F.lit(False)).alias("relevant")).alias("p"))
    lists = listed.groupBy(query).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    asked = passages.where(F.col("place") < first).select(query, F.col(key).alias("a"))
    wanted = preferences.join(asked, [query, "a"], "left_semi").groupBy(query).agg(F.collect_set(F.struct("a", "b")).alias("beats"))
    taken = within_budget(F.transform("ps", lambda p: p["words"]), F.lit(int(split[0] * budget)))
    judged = lists.withColumn("taken", taken).withColumn("ps", F.filter("ps", lambda p, i: F.element_at(F.col("taken"), i + 1)))
    yes = F.slice(F.transform(F.filter("ps", lambda p: p["relevant"]), lambda p: p["key"]), 1, int(split[1] * budget))
    no = F.transform(F.filter("ps", lambda p: ~p["relevant"]), lambda p: p["key"])
    sides = judged.select(query, yes.alias("yes"), no.alias("no")).join(wanted, query, "left")
    kind = dict(passages.dtypes)[key]
    beats = F.coalesce("beats", F.array().cast(f"array<struct<a:{kind},b:{kind}>>"))
    both = sides.select(query, F.concat(bubbled(F.col("yes"), beats), "no").alias("keys"), F.size("yes").alias("n"))
    return both.select(query, "n", F.posexplode("keys").alias("at", key)).select(query, key, (F.col("at") + 1).alias("rank"), (F.col("at") < F.col("n")).cast("double").alias("score"))


def heats(items: Column, size: int, out: int, better) -> Column:
    """One round: items in chunks of ``size`` (the last filled up from the first items on), each giving its ``out`` best in order, each item once."""
    n = F.size(items)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    chunk = lambda s: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.element_at(items, F.when(s + k < n, s + k).otherwise((s + k - n) % n) + 1))
    best = F.transform(starts, lambda s: F.slice(better(chunk(s)), 1, out))
    return F.array_distinct(F.flatten(best))


def tournament(items: Column, size: int, out: int, rounds: int = 1) -> Column:
    """array<struct(score, key, ...)> in order of a tournament: heats are played for at most ``rounds`` rounds, while more than ``size`` are left.

    A heat's members are ordered by score from the highest, equal ones by their place in the heat. What a round leaves
    out follows the winners of it in the order it had before; with one round this is the winners, then all others as they came.
    """

    def better(chunk: Column) -> Column:
        keyed = F.transform(chunk, lambda x, k: F.struct((-x["score"]).alias("s"), k.alias("k"), x.alias("x")))
        return F.transform(F.array_sort(keyed), lambda y: y["x"])

    none = F.slice(items, 1, 0)

    def step(state: Column, turn: Column) -> Column:
        now = state["now"]
        won = heats(now, size, out, better)
        played = F.struct(won.alias("now"), F.concat(F.array_except(now, won), state["rest"]).alias("rest"))
        return F.when((turn == 1) | (F.size(now) > size), played).otherwise(state)

    start = F.struct(items.alias("now"), none.alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: F.concat(s["now"], s["rest"]))


def tournament_rerank(hits: DataFrame, size: int = 5, out: int = 2, rounds: int = 1, first: int = 100, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, key, rank, score) from hits(query, key, place, score): each query's hits with place < first in the order of a tournament.

    The i-th of the new order gets the i-th score of the old one, as the scores are those of places. Null scores count as the least; an empty table gives no rows.
    """
    item = F.struct("place", F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("score"), F.col(key).alias("key"))
    lists = hits.where(F.col("place") < first).groupBy(query).agg(F.sort_array(F.collect_list(item)).alias("items"))
    ordered = lists.select(query, F.transform("items", lambda x: x["score"]).alias("scores"), tournament(F.col("items"), size, out, rounds).alias("items"))
    rows = ordered.select(query, "scores", F.posexplode("items").alias("at", "x"))
    return rows.select(query, F.col("x.key").alias(key), (F.col("at") + 1).alias("rank"), F.element_at("scores", F.col("at") + 1).alias("score"))


def training_slates(judged: DataFrame, negatives: int, query: str = "query_id", key: str = "doc_id", padding: str = "<padding_passage>") -> DataFrame:
    """(query, slate array<string>) from judged(query, key, place, positive, text): a query's first positive, then its first ``negatives`` that aren't positives.

    A document that is positive in any row is no negative; slates that are short are filled with the padding passage; queries without a positive have no slate.
    """
    rows = judged.withColumn("positive", F.coalesce("positive", F.lit(False)))
    good = rows.where("positive").groupBy(query).agg(F.min_by("text", F.struct("place", key)).alias("best"))
    positives = rows.where("positive").select(query, key).distinct()
    bad = rows.where("not positive").join(positives, [query, key], "left_anti")
    from pyspark.sql import Window

    order = Window.partitionBy(query).orderBy("place", key)
    first = bad.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= negatives)
    lists = first.groupBy(query).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "text"))), lambda x: x["text"]).alias("others"))
    whole = good.join(lists, query, "left").withColumn("others", F.coalesce("others", F.array().cast("array<string>")))
    return whole.select(query, F.concat(F.array("best"), "others", F.array_repeat(F.lit(padding), F.lit(negatives) - F.size("others"))).alias("slate"))
