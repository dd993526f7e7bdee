"""Operator 8: find training passages that hold benchmark items, by BM25 with block-max WAND and a check of both parts.

The index is over the test items, the queries are all passages (overlapping windows of words) of all training texts.
Impacts are divided by the item's score for itself, so 1 is the whole item and one threshold serves all. A passage's lists
are put in the order of their maxima: the pivot is the first list at which the sum of maxima reaches the threshold, and an
item that no list from the pivot on holds can't reach it. A passage without a pivot ends there. The blocks of items in the
lists from the pivot on are bounded by block maxima, first of those lists, then, where cursors on the others find the block,
of all; only the postings of blocks that are left are scored (numpy moves all cursors of a passage at once). A hit counts if the passage holds enough of the item's
question and of its answer. Lists and blocks are stored without their gaps, so an index is as large as its postings.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_batches

_WORD = re.compile(r"\w+")
HITS = "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double, passages long"


@dataclass(frozen=True)
class DecontaminationParams:
    """threshold: share of an item's own BM25 score; overlap: share of each part's gram-word runs; items_at_once bounds an index;
    there are as many as the benchmark needs, all broadcast, and a task holds one at a time while it reads its passages once."""

    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.6
    overlap: float = 0.7
    gram: int = 3
    block: int = 4
    items_at_once: int = 16384
    least_window: int = 64


def terms(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: split after the last question mark, or else after two thirds of the words."""
    at = text.rfind("?") + 1
    question, answer = terms(text[:at]), terms(text[at:])
    if question and answer:
        return question, answer
    words = question + answer
    cut = math.ceil(len(words) * 2 / 3)
    return words[:cut], words[cut:]


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    """Runs of n words, of all words if there are fewer."""
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def held(part: set[tuple[str, ...]], n: int, words: list[str], cache: dict[int, set]) -> float:
    """The share of a part's runs that a passage holds; an empty part is held."""
    if not part:
        return 1.0
    size = len(next(iter(part)))
    if size not in cache:
        cache[size] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    return len(part & cache[size]) / len(part)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start up to its end."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


#: Passages times blocks that are bounded at once.
CELLS = 1 << 21


class ItemIndex:
    """Postings with list and block maxima over items whose lengths one window suits.

    Term t's postings are places[bounds[t]:bounds[t + 1]] and impacts, by place; its blocks are blocks[block_bounds[t] ...]
    with their maxima and the start of each one's postings.
    """

    def __init__(self, items: list[tuple[int | None, str]], df: dict[str, int], n_items: int, mean: float, window: int, p: DecontaminationParams):
        self.p, self.window = p, window
        self.ids = [i for i, _ in items]
        self.parts = [tuple(grams(x, p.gram) for x in parts(t)) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        lists: list[list[tuple[int, float]]] = []
        for at, (_, text) in enumerate(items):
            tf = Counter(terms(text))
            length = sum(tf.values())
            weights = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (p.k1 + 1) / (c + p.k1 * (1 - p.b + p.b * length / mean)) for w, c in tf.items()}
            own = sum(weights.values())
            for w, x in weights.items():
                term = self.vocabulary.setdefault(w, len(lists))
                if term == len(lists):
                    lists.append([])
                lists[term].append((at, x / own))
        self.bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        self.places = np.array([a for x in lists for a, _ in x], np.int64)
        self.impacts = np.array([b for x in lists for _, b in x], np.float64)
        term = np.repeat(np.arange(len(lists)), np.diff(self.bounds))
        block = self.places // p.block
        new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        self.blocks, self.block_starts = block[new], np.concatenate((new, [len(term)]))
        self.block_max = np.maximum.reduceat(self.impacts, new) if len(new) else np.zeros(0)
        self.block_bounds = np.searchsorted(new, self.bounds)
        self.n_blocks = -(-len(items) // p.block)
        self.list_max = np.maximum.reduceat(self.impacts, self.bounds[:-1]) if len(lists) else np.zeros(0)
        self.scored = self.listed = 0  # postings that were scored, and that the lists of all passages have

    def search(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, place, score) of all items at or above the threshold, from distinct pairs (passage, term) sorted by passage.

        Block-max WAND for many passages at once: a passage's lists are taken in the order of their maxima. Those before the pivot can't
        reach the threshold together, so blocks are bounded by the others' block maxima first; the lists before the pivot
        are read only in blocks that are left, and postings only in blocks whose whole bound reaches the threshold.
        """
        self.listed += int((self.bounds[term + 1] - self.bounds[term]).sum())
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(term):
            return none
        step, out = max(1, CELLS // max(1, self.n_blocks)), []
        numbers = np.unique(passage, return_inverse=True)[1]
        edges = np.searchsorted(numbers, np.arange(0, numbers[-1] + step + 1, step))
        for a, b in zip(edges, edges[1:]):
            if a < b:
                out.append(self._search(passage[a:b], term[a:b]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else none

    def _search(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least, names = self.p.threshold - 1e-9, np.unique(passage)
        row, maxima = np.searchsorted(names, passage), self.list_max[term]
        able = np.bincount(row, weights=maxima) >= least  # else no pivot: all lists together can't reach the threshold
        keep = able[row]
        names, row, term, maxima = names[able], (np.cumsum(able) - 1)[row[keep]], term[keep], maxima[keep]
        n = len(names)
        order = np.lexsort((maxima, row))
        row, term, maxima = row[order], term[order], maxima[order]
        sums = np.cumsum(maxima)
        first = np.searchsorted(row, np.arange(n))
        reach = sums - np.concatenate(([0.0], sums))[first][row]
        after = reach >= least  # from the pivot on
        rest = np.bincount(row[~after], weights=maxima[~after], minlength=n)

        def blocks_of(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(block entry, cell of its passage and block) of the lists of these pairs."""
            low, high = self.block_bounds[term[of]], self.block_bounds[term[of] + 1]
            at = _ranges(low, high)
            return at, np.repeat(row[of], high - low) * self.n_blocks + self.blocks[at]

        at, cell = blocks_of(np.flatnonzero(after))
        bound = np.bincount(cell, weights=self.block_max[at], minlength=n * self.n_blocks)
        alive = bound + np.repeat(rest, self.n_blocks) >= least
        hopeful = alive.reshape(n, self.n_blocks).any(1)
        at, cell = blocks_of(np.flatnonzero(~after & hopeful[row]))
        at, cell = at[alive[cell]], cell[alive[cell]]
        bound += np.bincount(cell, weights=self.block_max[at], minlength=n * self.n_blocks)
        alive &= bound >= least
        hopeful = alive.reshape(n, self.n_blocks).any(1)
        at, cell = blocks_of(np.flatnonzero(hopeful[row]))
        at, cell = at[alive[cell]], cell[alive[cell]]
        low, high = self.block_starts[at], self.block_starts[at + 1]
        postings = _ranges(low, high)
        self.scored += len(postings)
        pair, back = np.unique(np.repeat(cell // self.n_blocks, high - low) * len(self.ids) + self.places[postings], return_inverse=True)
        scores = np.bincount(back, weights=self.impacts[postings], minlength=len(pair))
        good = scores >= least
        return names[pair[good] // len(self.ids)], pair[good] % len(self.ids), scores[good]

    def hits(self, texts: list[list[str]]) -> list[dict[int | None, list[float]]]:
        """For each text: item id -> [best score, its question and answer overlap, passages that hold it]."""
        out: list[dict[int | None, list[float]]] = [{} for _ in texts]
        get, step = self.vocabulary.get, self.window // 2
        owner, start, low, high, known, size = [], [], [], [], [], 0
        for i, words in enumerate(texts):
            ids = np.array([get(w, -1) for w in words], np.int64)
            at = np.flatnonzero(ids >= 0)
            if len(at):
                begins = np.arange(0, max(1, len(words) - step), step)
                owner.append(np.full(len(begins), i))
                start.append(begins)
                low.append(np.searchsorted(at, begins) + size)
                high.append(np.searchsorted(at, begins + self.window) + size)
                known.append(ids[at])
                size += len(at)
        if not known:
            return out
        owner, start, low, high, known = map(np.concatenate, (owner, start, low, high, known))
        pairs = np.unique(np.repeat(np.arange(len(start)), high - low) * len(self.list_max) + known[_ranges(low, high)])
        found: dict[int, list[tuple[int, float]]] = {}
        for number, place, score in zip(*(x.tolist() for x in self.search(pairs // len(self.list_max), pairs % len(self.list_max)))):
            found.setdefault(number, []).append((place, score))
        for number, items in sorted(found.items()):
            passage = texts[owner[number]][start[number] : start[number] + self.window]
            cache: dict[int, set] = {}
            for place, score in items:
                question, answer = (held(x, self.p.gram, passage, cache) for x in self.parts[place])
                if min(question, answer) >= self.p.overlap:
                    old = out[owner[number]].setdefault(self.ids[place], [0.0, 0.0, 0.0, 0])
                    old[:3] = max(tuple(old[:3]), (score, question, answer))
                    old[3] += 1
        return out


def build_indexes(items: list[tuple[int | None, str]], df: dict[str, int], n_items: int, mean: float, p: DecontaminationParams) -> list[ItemIndex]:
    """One index for each class of lengths (up to 32 words, then fourfold), with windows of twice the class's longest item."""
    classes: dict[int, list[tuple[int, str]]] = {}
    for item in items:
        n = len(terms(item[1]))
        size = p.least_window // 2
        while size < n:
            size *= 4
        classes.setdefault(size, []).append(item)
    return [ItemIndex(xs, df, n_items, mean, max(p.least_window, 2 * max(len(terms(t)) for _, t in xs)), p) for _, xs in sorted(classes.items())]


def item_statistics(benchmark: DataFrame) -> tuple[int, float, DataFrame]:
    """Number of items with words, their mean length, and (term, df)."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches):
        for batch in batches:
            counted = [Counter(terms(t)) for t in batch.column(0).to_pylist()]
            rows = [(w, c) for x in counted for w, c in x.items()] + [(None, sum(x.values())) for x in counted if x]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["term", "tf"])

    counts = map_batches(benchmark.select("text"), run, schema).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    whole = counts.where("term is null").first()
    return (whole["df"], whole["total"] / whole["df"], counts.where("term is not null")) if whole else (0, 1.0, counts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams(), carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, item_id, bm25, question_overlap, answer_overlap, passages, and the columns of docs to carry): each item that a document holds.

    Reads docs(doc_id, text) and benchmark(item_id, text). Null and empty texts hold nothing, items without words are
    held by nothing, a null doc_id or item_id stays null, items that share an id count as one, of passages with equal scores that with the larger overlaps is told, repeated rows give repeated hits,
    empty tables give none. Texts of any length are searched whole. All passages are searched against all items in one
    pass over docs; the driver holds items_at_once items at a time.
    """
    spark = docs.sparkSession
    n_items, mean, df = item_statistics(benchmark)
    rows = docs.select(F.col("doc_id").cast("long"), "text", *carry).where("text is not null")
    schema = T.StructType([*T._parse_datatype_string(HITS).fields, *rows.schema.fields[2:]])
    blocks = -(-n_items // p.items_at_once)
    sent = []
    for block in range(blocks):
        mine = benchmark.select(F.col("item_id").cast("long"), "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = sorted(((r[0], r[1]) for r in mine.collect() if terms(r[1])), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if not items:
            continue
        seen = {w for _, t in items for w in terms(t)}
        need = spark.createDataFrame(pa.table({"term": pa.array(sorted(seen), pa.string())}))
        known = {r["term"]: r["df"] for r in df.join(need, "term").select("term", "df").collect()}
        sent.append(spark.sparkContext.broadcast(cloudpickle.dumps(build_indexes(items, known, n_items, mean, p))))  # with its classes: executors have no copy of them
    return map_batches(rows, _searcher(sent, len(carry)), schema) if sent else spark.createDataFrame([], schema)


#: Characters of passages that a task holds while it goes through the indexes.
HELD_CHARS = 1_000_000


def _searcher(sent: list, carried: int):
    def indexes():
        for one in sent:
            yield pickle.loads(one.value)
            one.__dict__.pop("_value", None)  # read again from the local copy for the next passages

    def search(batch: pa.RecordBatch, only: list | None):
        texts = [terms(x.as_py()) for x in batch.column(1)]
        found = []
        for block in [only] if only is not None else indexes():
            for index in block:
                for i, hits in enumerate(index.hits(texts)):
                    found += [(i, item, *x) for item, x in sorted(hits.items(), key=lambda x: (x[0] is None, x[0] or 0))]
        found.sort(key=lambda x: x[0])
        cols = list(zip(*found)) or [()] * 6
        rows = pa.array(cols[0], pa.int64())
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        hits = [batch.column(0).take(rows), *(pa.array(c, k) for c, k in zip(cols[1:], kinds)), *(batch.column(2 + i).take(rows) for i in range(carried))]
        return pa.RecordBatch.from_arrays(hits, ["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap", "passages", *batch.schema.names[2:]])

    def run(batches):
        only = next(indexes()) if len(sent) == 1 else None  # a single index stays for the whole task
        for batch in batches:
            start, size = 0, 0
            for i, text in enumerate(batch.column(1)):
                size += len(text.as_buffer())
                if size >= HELD_CHARS:
                    yield search(batch.slice(start, i + 1 - start), only)
                    start, size = i + 1, 0
            if start < batch.num_rows:
                yield search(batch.slice(start), only)

    return run
