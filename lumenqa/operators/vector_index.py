"""An inverted-list index over vectors, and codebooks in subspaces.

Centroids are fitted on a bounded sample on the driver; every vector is then listed under its nearest centroid by the tasks. A search
meets a query only with the lists it is sent to, so no step pairs all rows with all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .order import cut
from .retrieval import top_k

#: Rows of a list that one task meets with a block of queries at once.
BLOCK = 1024

#: Cells of queries by lists, which are also rows of queries that are sent, that a task holds at once.
SENT = 1 << 16


@dataclass(frozen=True)
class IndexParams:
    """lists: centroids, None for the square root of the rows, at most max_lists; sample: vectors that they are fitted on at most;
    recall: the share of a sampled query's nearest vectors that its probed lists must hold, which sets the number of probes."""

    lists: int | None = None
    max_lists: int = 4096
    sample: int = 20_000
    rounds: int = 10
    recall: float = 0.97
    seed: int = 7


@dataclass
class VectorIndex:
    """centroids: unit vectors; rows(list, vec_id, embedding), embedding at unit length; probes: lists a query is sent to.
    sizes and radii: rows of each list, and the largest distance of one from its centroid."""

    centroids: np.ndarray
    rows: DataFrame
    probes: int
    sizes: np.ndarray
    radii: np.ndarray


def sample_matrix(vectors: DataFrame, n: int, key: str = "vec_id") -> np.ndarray:
    """At most n vectors as a matrix, those with the smallest hash of their key: the same in every run."""
    rows = vectors.orderBy(F.xxhash64(key), key).limit(n).select("embedding").collect()
    return np.array([r[0] for r in rows], np.float64) if rows else np.zeros((0, 0))


def k_means(points: np.ndarray, k: int, rounds: int = 10, seed: int = 7, spherical: bool = False) -> np.ndarray:
    """At most k centroids of a matrix that fits in memory, by Lloyd's rounds from distinct random points; empty ones are dropped."""
    distinct = np.unique(points, axis=0)
    centroids = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds if len(centroids) else 0):
        near = nearest(points, centroids)
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        centroids = sums[counts > 0] / counts[counts > 0, None]
        if spherical:
            centroids = B.unit(centroids)
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of each point's nearest centroid, in slices so that no matrix of all distances is held."""
    out, half = np.empty(len(points), np.int64), (centroids * centroids).sum(1) / 2
    step = max(1, (1 << 22) // max(1, len(centroids)))
    for i in range(0, len(points), step):
        out[i : i + step] = (points[i : i + step] @ centroids.T - half).argmax(1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), matrix.shape[1]).cast(pa.list_(pa.float64()))


def _probes_needed(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The number of nearest lists that hold the wanted share of the k nearest of up to 500 sampled queries among the sample."""
    queries = sample[:: max(1, len(sample) // 500)]
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(0, len(sample), max(1, len(sample) // 500))[: len(queries)]] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : max(1, min(k, len(sample) - 1))]
    place = np.argsort(np.argsort(-(queries @ centroids.T), axis=1), axis=1)
    at = place[np.arange(len(queries))[:, None], nearest(sample, centroids)[best]]
    return int(np.quantile(at, recall)) + 1


def build(vectors: DataFrame, p: IndexParams = IndexParams(), k: int = 10) -> VectorIndex:
    """Index every row of vectors(vec_id, embedding) by cosine; rows with a null id or vector are left out, a zero vector is listed as it is.

    Only p.sample vectors come to the driver, whatever the table's size. probes are set so that sampled queries find p.recall of their
    k nearest sampled vectors.
    """
    rows = cut(vectors.select("vec_id", "embedding").dropna())
    n = rows.count()
    sample = B.unit(sample_matrix(rows, p.sample))
    lists = min(p.lists or int(n**0.5) + 1, p.max_lists)
    centroids = k_means(sample, lists, p.rounds, p.seed, spherical=True)
    spark = vectors.sparkSession
    if not n:
        return VectorIndex(centroids, spark.createDataFrame([], "list int, vec_id long, embedding array<double>"), 1, np.zeros(0, int), np.zeros(0))
    sent = spark.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            x = B.unit(_matrix(batch.column(1)))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(nearest(x, sent.value).astype(np.int32)), batch.column(0).cast(pa.int64()), _lists(x)], ["list", "vec_id", "embedding"])

    listed = cut(rows.mapInArrow(run, "list int, vec_id long, embedding array<double>"))
    stats = _list_stats(listed, centroids)
    sizes, radii = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in stats.collect():  # a row a list, of which there are max_lists at most
        sizes[r["list"]], radii[r["list"]] = r["size"], r["radius"]
    return VectorIndex(centroids, listed, _probes_needed(sample, centroids, k, p.recall), sizes, radii)


def _list_stats(listed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(list, size, radius) of every list that has rows."""
    sent = listed.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            away = np.linalg.norm(_matrix(batch.column(1)) - sent.value[at], axis=1) if len(at) else np.zeros(0)
            lists, back = np.unique(at, return_inverse=True)
            radius = np.zeros(len(lists))
            np.maximum.at(radius, back, away)
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(np.bincount(back, minlength=len(lists)).astype(np.int64)), pa.array(radius)], ["list", "size", "radius"])

    return listed.select("list", "embedding").mapInArrow(run, "list int, size long, radius double").groupBy("list").agg(F.sum("size").alias("size"), F.max("radius").alias("radius"))


def _sent(index: VectorIndex, queries: DataFrame, skip: int = 0, take: int | None = None) -> DataFrame:
    """(list, query_id, query) for the take nearest lists of each query after the first skip; where queries have ``least``, a cosine, only lists that can
    hold a vector as near: by the triangle inequality none of a list is nearer than its centroid less its radius."""
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast((index.centroids, index.radii, index.sizes))
    bounded, step = "least" in queries.columns, max(1, SENT // max(1, len(index.centroids)))

    def run(batches):
        centroids, radii, sizes = sent.value
        for batch in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            x = B.unit(_matrix(batch.column(1)))
            if not len(x):
                continue
            cosine = x @ centroids.T
            order = np.argsort(-cosine, axis=1, kind="stable")[:, skip : None if take is None else skip + take]
            row, lists = np.repeat(np.arange(len(x)), order.shape[1]), order.ravel()
            keep = sizes[lists] > 0
            if bounded:
                away = np.sqrt(np.maximum(0, 2 - 2 * cosine[row, lists])) - radii[lists]
                least = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)  # a null, too few hits yet, becomes NaN
                limit = np.sqrt(np.maximum(0, 2 - 2 * least))[row]
                keep &= ~(away > limit + 1e-6)
            row, lists = row[keep], lists[keep]
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), batch.column(0).cast(pa.int64()).take(pa.array(row)), _lists(x[row] if len(row) else np.zeros((0, x.shape[1])))], ["list", "query_id", "query"])

    columns = ["query_id", "query", *(["least"] if bounded else [])]
    return queries.select(*columns).mapInArrow(run, "list int, query_id long, query array<double>")


def _packed(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """(list, name array<struct>) of blocks of about BLOCK rows; a list of any size is many blocks."""
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK))
    dealt = rows.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.monotonically_increasing_id(), n))
    fields = [c for c in rows.columns if c != "list"]
    return dealt.groupBy("list", "block").agg(F.collect_list(F.struct(*fields)).alias(name)).drop("block")


def _met(index: VectorIndex, sent: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block of a list for each query that was sent to it."""
    spark = sent.sparkSession
    sent = cut(sent)
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(index.sizes) if n], "list int, size long")
    asked = sent.groupBy("list").agg(F.count(F.lit(1)).alias("size"))  # a row a list
    left, right = _packed(sent, asked, "a"), _packed(index.rows, sizes, "b")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = B.flat(batch.column(0), i), B.flat(batch.column(1), i)
                cosine = a["query"] @ b["embedding"].T
                row, column = B.best_columns(cosine, b["vec_id"], k, a["query_id"][:, None] != b["vec_id"][None, :])
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(a["query_id"][row]), pa.array(b["vec_id"][column]), pa.array(cosine[row, column])], ["query_id", "vec_id", "score"])

    return left.join(right, "list").select("a", "b").mapInArrow(run, "query_id long, vec_id long, score double")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best by cosine in the lists that each query(query_id, query) is sent to; an id is no hit of itself.

    The hits of the probed lists are exact; a vector in another list is missed. Null queries give none, ties go to the smaller id.
    """
    return top_k(_met(index, _sent(index, queries.dropna(), 0, probes or index.probes), k), "query_id", "vec_id", k)


def search_exact(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """As search, over all vectors: after the probed lists, a query goes to those others only that can hold one better than its k-th.

    A list's vectors are no nearer than the distance to its centroid less its radius, so nothing is missed.
    """
    queries = cut(queries.select("query_id", "query").dropna())
    first = cut(_met(index, _sent(index, queries, 0, index.probes), k))
    least = top_k(first, "query_id", "vec_id", k).where(F.col("rank") == k).select("query_id", F.round(F.col("score"), 9).alias("least"))
    rest = _met(index, _sent(index, queries.join(least, "query_id", "left"), index.probes), k)
    return top_k(first.union(rest), "query_id", "vec_id", k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact(query_id, vec_id) that was found."""
    row = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.count("hit"), F.count(F.lit(1))).first()
    return row[0] / row[1] if row[1] else 1.0


# codebooks


@dataclass(frozen=True)
class Codebooks:
    """starts: first coordinate of each subspace and the number of coordinates; words: the code words of each."""

    starts: tuple[int, ...]
    words: tuple[np.ndarray, ...]


def fit_codebooks(vectors: DataFrame, subspaces: int = 8, words: int = 16, sample: int = 1000, seed: int = 7) -> Codebooks:
    """Code words of each subspace by k-means on at most ``sample`` vectors; the first subspaces take what is left of the coordinates."""
    points = sample_matrix(vectors.select("vec_id", "embedding").dropna(), sample)
    if not len(points):
        return Codebooks((0,), ())
    sizes = [points.shape[1] // subspaces + (i < points.shape[1] % subspaces) for i in range(subspaces)]
    starts = tuple(int(s) for s in np.concatenate(([0], np.cumsum(sizes))))
    return Codebooks(starts, tuple(k_means(points[:, a:b], words, seed=seed + i) for i, (a, b) in enumerate(zip(starts, starts[1:]))))


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, part, code, miss): each vector's nearest code word in each subspace and its distance from it."""
    sent = vectors.sparkSession.sparkContext.broadcast((books.starts, books.words))  # plain values: executors have no copy of the class

    def run(batches):
        starts, all_words = sent.value
        for batch in batches:
            x = _matrix(batch.column(2))
            for part, words in enumerate(all_words if len(x) else ()):
                piece = x[:, starts[part] : starts[part + 1]]
                code = nearest(piece, words)
                miss = np.linalg.norm(piece - words[code], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(np.full(len(x), part, np.int32)), pa.array(code.astype(np.int32)), pa.array(miss)], ["vec_id", "label", "part", "code", "miss"])

    return vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").dropna().mapInArrow(run, "vec_id long, label long, part int, code int, miss double")


#: Rows of the table of clusters and subspaces that are broadcast; beyond it, they are joined by a shuffle.
MAX_SENT_TABLE = 100_000


def codebook_bounds(vectors: DataFrame, subspaces: int = 8, words: int = 16, sample: int = 1000) -> DataFrame:
    """(vec_id, label, bound): upper bounds of the largest distance from each vector to each cluster's members, by codebooks.

    In every subspace: the vector's distance from its code word, plus the largest distance of that word from a word that the
    cluster uses, plus the cluster's largest distance of a member from its word. The subspaces' bounds add up. Rows with a null are left out.
    """
    books = fit_codebooks(vectors, subspaces, words, sample)
    spark = vectors.sparkSession
    if not books.words:
        return spark.createDataFrame([], "vec_id long, label long, bound double")
    coded = cut(encode(vectors, books))
    between = [(part, i, j, float(np.linalg.norm(w[i] - w[j]))) for part, w in enumerate(books.words) for i in range(len(w)) for j in range(len(w))]
    apart = F.broadcast(spark.createDataFrame(between, "part int, code int, used int, apart double"))  # subspaces x words x words rows
    used = coded.groupBy("label", "part", F.col("code").alias("used")).agg(F.max("miss").alias("miss"))
    spread = used.groupBy("label", "part").agg(F.max("miss").alias("spread"))
    far = used.join(apart, ["part", "used"]).groupBy("label", "part", "code").agg(F.max("apart").alias("far")).join(spread, ["label", "part"])
    far = cut(far.groupBy("label", "part").agg(F.map_from_entries(F.collect_list(F.struct("code", F.col("far") + F.col("spread")))).alias("far")))
    table = F.broadcast(far) if far.count() <= MAX_SENT_TABLE else far
    return coded.drop("label").join(table, "part").groupBy("vec_id", "label").agg(F.sum(F.col("miss") + F.element_at("far", F.col("code"))).alias("bound"))
